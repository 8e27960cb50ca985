"""Vectors: context embeddings, nearest items, clustering with its measures, cluster trees, PCA.

Pairs of two tables are formed only where one side is a bounded list (centres, items of a list whose
size is checked). A table of any size is compared with itself block by block; everything else is
aggregates and joins on keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot, doubles, l2_normalize, mean_vector, similarity
from corpusmill.plans.lineage import written

#: Rows of a list that may be sent to every task.
MOST_LISTED = 100_000
#: Rows of a block where a table is compared with itself.
BLOCK = 4096


def listed(df: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """`df` for a broadcast, after its size has been checked."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to compare with; use the leaf search of nearest neighbours")
    return F.broadcast(df)


def _list(df: DataFrame, key: str, vec: str, *more: str, most: int = MOST_LISTED) -> pd.DataFrame:
    """A bounded list at the driver, in order of its key, vectors as a matrix in attrs["m"]; refused beyond `most` rows."""
    p = df.where(F.col(vec).isNotNull()).select(key, doubles(F.col(vec)).alias("_v"), *more).limit(most + 1).toPandas().sort_values(key, ignore_index=True)
    if len(p) > most:
        raise ValueError(f"more than {most} rows to compare with; use the leaf search of nearest neighbours")
    p.attrs["m"] = np.stack(p["_v"].to_numpy()) if len(p) else np.zeros((0, 1))
    return p.drop(columns="_v")


def _against(v: DataFrame, key: str, vec: str, held: pd.DataFrame, work, schema: str, *more: str) -> DataFrame:
    """`work(ids, matrix, batch, held)` over batches of `v`, with the list sent to every task once."""
    box = v.sparkSession.sparkContext.broadcast((held, held.attrs["m"]))

    def run(it):
        h, m = box.value
        for p in it:
            if len(p) and len(h):
                for s in range(0, len(p), 1024):
                    q = p.iloc[s : s + 1024]
                    yield work(q[key].to_numpy(), np.stack(q["_v"].to_numpy()), q, h, m)

    return v.where(F.col(vec).isNotNull()).select(key, doubles(F.col(vec)).alias("_v"), *more).mapInPandas(run, schema)


def _in_blocks(v: DataFrame, key: str, vec: str, work, schema: str, *more: str, by: str | None = None) -> DataFrame:
    """`work(p, x, q, y)` over all pairs of blocks of `v`, or of each group of `by`: rows and matrix of the one
    block and of the other; the same rows twice where a block meets itself. A row lies in the block of its
    key's hash; each two blocks meet once, in a row set of their own."""
    rows = v.where(F.col(vec).isNotNull()).select(key, doubles(F.col(vec)).alias("_v"), *more, *([by] if by else []))
    if by:
        b = rows.join(rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts")), by)
    else:
        b = rows.withColumn("_parts", F.lit(max(1, -(-rows.count() // BLOCK))))
    b = b.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    b = b.withColumns({"_bi": F.least("_own", "_o"), "_bj": F.greatest("_own", "_o")}).drop("_parts", "_o")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, i = np.stack(pdf["_v"].to_numpy()), (pdf["_own"] == pdf["_bi"]).to_numpy()
        if pdf["_bi"].iat[0] == pdf["_bj"].iat[0]:
            return work(pdf, x, pdf, x)
        return work(pdf[i], x[i], pdf[~i], x[~i]) if 0 < i.sum() < len(i) else pd.DataFrame(columns=names)

    return b.groupBy(*([by] if by else []), "_bi", "_bj").applyInPandas(lambda p: run(p), schema)


def group_means(v: DataFrame, key: str, dim: int, vec: str = "embedding", unit: bool = True) -> DataFrame:
    """(key, n, mean): element-wise mean of each group, at unit length if asked."""
    g = v.where(F.col(vec).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), mean_vector(F.col(vec), dim).alias("m"))
    return g.select(key, "n", (l2_normalize(F.col("m")) if unit else F.col("m")).alias("mean"))


def grouped_by_label(v: DataFrame, label: str = "label", ind: str = "vec_id") -> DataFrame:
    """(label, inds): the rows of each label in order of index."""
    return v.groupBy(label).agg(F.sort_array(F.collect_list(ind)).alias("inds"))


def inner_products(a: DataFrame, b: DataFrame, vec: str = "embedding", least: float | None = None) -> DataFrame:
    """(a_id, b_id, ip) of all pairs of `a` and the bounded list `b`, both (vec_id, vec); with `least`, of
    those whose product, rounded to 9 places, is that or more. The list is one matrix in every task."""

    def work(ids, x, q, h, m):
        ip = x @ m.T
        i, j = np.nonzero(np.round(ip, 9) >= (-np.inf if least is None else least))
        return pd.DataFrame({"a_id": ids[i], "b_id": h["vec_id"].to_numpy()[j], "ip": ip[i, j]})

    return _against(a, "vec_id", vec, _list(b, "vec_id", vec), work, "a_id long, b_id long, ip double")


def inner_products_within(v: DataFrame, vec: str = "embedding", least: float | None = None) -> DataFrame:
    """J10 of a table with itself: (a_id, b_id, ip) of all ordered pairs of `v`, each with itself too; `least` as in
    inner_products. Block meets block, so no list of all is needed."""

    def work(p, x, q, y):
        a, b, out, same = p["vec_id"].to_numpy(), q["vec_id"].to_numpy(), [], p is q
        for s in range(0, len(x), 1024):
            ip = x[s : s + 1024] @ y.T
            i, j = np.nonzero(np.round(ip, 9) >= (-np.inf if least is None else least))
            out.append(pd.DataFrame({"a_id": a[s + i], "b_id": b[j], "ip": ip[i, j]}))
            if not same:
                out.append(pd.DataFrame({"a_id": b[j], "b_id": a[s + i], "ip": ip[i, j]}))
        return pd.concat(out)

    return _in_blocks(v, "vec_id", vec, work, "a_id long, b_id long, ip double")


def worst_inner_product(v: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row (worst): the least inner product of any two vectors, each with itself too. Copies of a vector
    count once; each two blocks give one number on."""

    def work(p, x, q, y):
        return pd.DataFrame({"w": [min(float((x[s : s + 1024] @ y.T).min()) for s in range(0, len(x), 1024))]})

    each = v.select(doubles(F.col(vec)).alias("_k")).distinct()
    return _in_blocks(each, "_k", "_k", work, "w double").agg(F.min("w").alias("worst"))


def nearest_item(v: DataFrame, items: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, item_id, ip): the item of the greatest inner product, rounded to 9 places; at equal
    ones the smaller id. Items are a bounded list, one matrix in every task; nothing is shuffled."""

    def work(ids, x, q, h, m):
        ip = np.round(x @ m.T, 9)
        at = ip.argmax(1)
        return pd.DataFrame({"vec_id": ids, "item_id": h["item_id"].to_numpy()[at], "ip": ip[np.arange(len(at)), at]})

    return _against(v, "vec_id", vec, _list(items, "item_id", vec), work, "vec_id long, item_id long, ip double")


def context_embeddings(terms: DataFrame, contexts: DataFrame, dim: int, term_weight: float = 10.0, sentence_weight: float = 1.0) -> DataFrame:
    """(term, embedding): unit vector of term_weight * e + sentence_weight * unit mean of the context's
    sentences (repeats count again); the term's own vector where it has no context. `contexts` is
    (term, embedding) of the sentences. All inputs are in the plan, so nothing stale is read."""
    ctx = group_means(contexts, "term", dim).select("term", F.col("mean").alias("_c"))
    j = terms.join(ctx, "term", "left")
    mixed = F.zip_with(doubles(F.col("embedding")), F.col("_c"), lambda x, y: term_weight * x + sentence_weight * y)
    return j.select("term", F.when(F.col("_c").isNull(), doubles(F.col("embedding"))).otherwise(l2_normalize(mixed)).alias("embedding"))


def close_communities(v: DataFrame, threshold: float = 0.96, min_size: int = 2, vec: str = "embedding") -> DataFrame:
    """(community, vec_id): neighbourhoods of unit vectors at `threshold` similarity, the largest first,
    members of an earlier one left out of later ones; those that keep `min_size` stay. community is the
    smallest id. Pairs above the threshold are found block by block; as picks in one connected
    component don't touch another, each component is picked from by itself."""
    from corpusmill.operators.graph import connected_components

    p = written(inner_products_within(v, vec, threshold), "near")
    comp = connected_components(p, "a_id", "b_id").select(F.col("node").alias("a_id"), "component")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(g) for k, g in pdf.groupby("a_id")["b_id"]}
        taken, rows = set(), []
        for k in sorted(near, key=lambda k: (-len(near[k]), k)):
            free = [x for x in near[k] if x not in taken]
            if k not in taken and len(near[k]) >= min_size and len(free) >= min_size:
                taken.update(free)
                rows += [(min(free), x) for x in free]
        return pd.DataFrame(rows, columns=["community", "vec_id"]).astype("int64")

    return p.join(comp, "a_id").groupBy("component").applyInPandas(lambda x: pick(x), "community long, vec_id long")


def represented_synonyms(communities: DataFrame, counts: DataFrame) -> DataFrame:
    """(syn, rep) by id: in each community the member of the highest count (ties: the smaller id) stands for the rest."""
    c = communities.join(counts, "vec_id", "left").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc_nulls_last("cnt"), "vec_id")))
    rep = c.where("r = 1").select("community", F.col("vec_id").alias("rep"))
    return communities.join(rep, "community").where("vec_id <> rep").select(F.col("vec_id").alias("syn"), "rep")


def noise_assigned(v: DataFrame, dim: int, noise: int = -1) -> DataFrame:
    """C10, noise: `v` (vec_id, embedding, label) with noise given to the label whose unit mean is nearest
    (ties: the smaller label). Labels are a bounded list."""
    means = group_means(v.where(F.col("label") != noise), "label", dim).select(F.col("label").cast("long").alias("item_id"), F.col("mean").alias("embedding"))
    near = nearest_item(v.where(F.col("label") == noise).select("vec_id", "embedding"), means)
    return v.join(near.select("vec_id", "item_id"), "vec_id", "left").withColumn("label", F.when(F.col("label") == noise, F.col("item_id").cast("int")).otherwise(F.col("label"))).drop("item_id")


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def silhouette(v: DataFrame, by: str | None = None) -> DataFrame:
    """One row (silhouette): mean over vectors of (b - a) / max(a, b), Euclidean, 0 in a label of one
    vector; of each group, (by, silhouette), if asked. Distances are added up per vector and label of the
    other block, then over the blocks."""
    keys = [by] if by else []

    def one_way(p, x, q, y, same):
        at = np.argsort(q["label"].to_numpy(), kind="stable")
        labels, start, size = np.unique(q["label"].to_numpy()[at], return_index=True, return_counts=True)
        m, other, own, yy = y[at], q["vec_id"].to_numpy()[at], p["vec_id"].to_numpy(), (y[at] * y[at]).sum(1)
        sums = []
        for s in range(0, len(x), 1024):
            z = x[s : s + 1024]
            d = np.sqrt(np.maximum((z * z).sum(1)[:, None] + yy - 2 * z @ m.T, 0))
            if same:
                d[own[s : s + 1024, None] == other] = 0
            sums.append(np.add.reduceat(d, start, axis=1))
        k = len(labels)
        return pd.DataFrame({**{c: np.repeat(p[c].to_numpy(), k) for c in keys}, "vec_id": np.repeat(own, k), "label": np.repeat(p["label"].to_numpy(), k), "o": np.tile(labels, len(x)), "d": np.concatenate(sums).ravel(), "n": np.tile(size, len(x))})

    def work(p, x, q, y):
        return one_way(p, x, q, y, True) if p is q else pd.concat([one_way(p, x, q, y, False), one_way(q, y, p, x, False)])

    kind = dict(v.dtypes)
    schema = ", ".join([*(f"{c} {kind[c]}" for c in keys), f"vec_id {kind['vec_id']}", f"label {kind['label']}", f"o {kind['label']}", "d double", "n long"])
    t = _in_blocks(v, "vec_id", "embedding", work, schema, "label", by=by).groupBy(*keys, "vec_id", "label", "o").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("o")
    t = t.groupBy(*keys, "vec_id", "label").agg(F.max(F.when(own, F.col("d") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when((F.col("n") < 2) | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return t.groupBy(*keys).agg(F.avg(s).alias("silhouette"))


def davies_bouldin(v: DataFrame, dim: int) -> DataFrame:
    """One row (davies_bouldin): mean over labels of the worst (s_i + s_j) / d_ij, s the mean distance to
    the label's mean, d between means. Labels meet labels; vectors only their own mean."""
    c = group_means(v, "label", dim, unit=False)
    s = v.join(c, "label").groupBy("label").agg(F.avg(_distance(F.col("embedding"), F.col("mean"))).alias("s"))
    x = c.join(s, "label").select("label", "mean", "s")
    y = listed(x.select(F.col("label").alias("l2"), F.col("mean").alias("m2"), F.col("s").alias("s2")), 10_000)
    r = x.join(y, F.col("label") != F.col("l2")).groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / _distance(F.col("mean"), F.col("m2"))).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(v: DataFrame, dim: int) -> DataFrame:
    """One row (calinski_harabasz): spread between label means over spread within, each by its degrees of freedom."""
    c = group_means(v, "label", dim, unit=False)
    whole = v.agg(mean_vector(F.col("embedding"), dim).alias("g"), F.count("*").alias("total"))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(_distance(F.col("mean"), F.col("g")), 2)).alias("bss"), F.count("*").alias("k"), F.max("total").alias("total"))
    within = v.join(c, "label").agg(F.sum(F.pow(_distance(F.col("embedding"), F.col("mean")), 2)).alias("wss"))
    return between.crossJoin(F.broadcast(within)).select((F.col("bss") * (F.col("total") - F.col("k")) / (F.col("wss") * (F.col("k") - 1))).alias("calinski_harabasz"))


def exemplars(members: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """(cluster_id, exemplar_id, exemplar_sim, global_exemplar_id, global_sim, parent_sim): of each cluster
    the member nearest its own and the global unit mean, with scaled similarities; parent_sim of the means
    rounded to 4, -1 at a root. `members` (cluster_id, vec_id, embedding), `clusters` (cluster_id, parent_id)."""
    c = group_means(members, "cluster_id", dim).select("cluster_id", "mean")
    whole = members.dropDuplicates(["vec_id"]).agg(l2_normalize(mean_vector(F.col("embedding"), dim)).alias("g"))
    j = members.join(c, "cluster_id").crossJoin(F.broadcast(whole))
    best = lambda x: F.max(F.struct(F.round(x, 9).alias("s"), (-F.col("vec_id")).alias("i")))
    b = j.groupBy("cluster_id").agg(best(similarity(F.col("embedding"), F.col("mean"))).alias("own"), best(similarity(F.col("embedding"), F.col("g"))).alias("all"))
    p = clusters.select("cluster_id", "parent_id").join(c, "cluster_id").join(c.select(F.col("cluster_id").alias("parent_id"), F.col("mean").alias("pm")), "parent_id", "left")
    p = p.select("cluster_id", F.coalesce(F.round(similarity(F.col("mean"), F.col("pm")), 4), F.lit(-1.0)).alias("parent_sim"))
    return b.join(p, "cluster_id").select("cluster_id", (-F.col("own.i")).alias("exemplar_id"), F.col("own.s").alias("exemplar_sim"), (-F.col("all.i")).alias("global_exemplar_id"), F.col("all.s").alias("global_sim"), "parent_sim")


def described_by_items(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """(vec_id, description, ip): the nearest of described items (item_id, embedding, description) to each vector."""
    near = nearest_item(clusters, items.select("item_id", "embedding"))
    return near.join(items.select("item_id", "description"), "item_id").select("vec_id", "description", "ip")


def cluster_leaves(clusters: DataFrame) -> DataFrame:
    """clusters that are no one's parent."""
    return clusters.join(clusters.select(F.col("parent_id").alias("cluster_id")).where("cluster_id IS NOT NULL").distinct(), "cluster_id", "left_anti")


def cluster_paths(clusters: DataFrame, most_levels: int = 1000) -> DataFrame:
    """C17: (cluster_id, path): ids from each cluster up to its root, by doubling: each round joins the paths
    known so far to those of their last id, so a depth of d takes log2(d) rounds."""
    p = clusters.select("cluster_id", "parent_id").distinct()
    p = written(p.select("cluster_id", F.array("cluster_id").alias("path"), F.col("parent_id").alias("up")), "paths")
    length = 1
    while not p.where("up IS NOT NULL").isEmpty():
        if length > most_levels:
            raise ValueError("parents form a cycle, or the tree is too deep")
        o = p.select(F.col("cluster_id").alias("up"), F.col("path").alias("p2"), F.col("up").alias("u2"))
        p = written(p.join(o, "up", "left").select("cluster_id", F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat("path", "p2")).alias("path"), "u2").withColumnRenamed("u2", "up"), "paths")
        length *= 2
    return p.select("cluster_id", "path")


def preorder(clusters: DataFrame) -> DataFrame:
    """Clusters in pre-order: by the path from the root."""
    p = cluster_paths(clusters).select("cluster_id", F.reverse("path").alias("from_root"))
    return clusters.join(p, "cluster_id").orderBy("from_root")


def _assembled(v: DataFrame) -> DataFrame:
    return v.where(F.col("embedding").isNotNull()).select("vec_id", array_to_vector(doubles(F.col("embedding"))).alias("features"))


def kmeans(v: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(vec_id, label)."""
    from pyspark.ml.clustering import KMeans

    x = _assembled(v)
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("vec_id", F.col("prediction").alias("label"))


def gaussian_mixture(v: DataFrame, k: int, dims: int | None = None, seed: int = 0) -> DataFrame:
    """(vec_id, label): a mixture over `dims` principal components (k by default, in place of a manifold
    projection, which Spark lacks)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA

    x = _assembled(v)
    z = PCA(k=min(dims or k, len(x.first()["features"])), inputCol="features", outputCol="pc").fit(x).transform(x).select("vec_id", F.col("pc").alias("features"))
    return GaussianMixture(k=k, seed=seed).fit(z).transform(z).select("vec_id", F.col("prediction").alias("label"))


def agglomerative(v: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(vec_id, label): by bisecting k-means, a distributed hierarchical clustering (divisive, not Ward's)."""
    from pyspark.ml.clustering import BisectingKMeans

    x = _assembled(v)
    return BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=2).fit(x).transform(x).select("vec_id", F.col("prediction").alias("label"))


def ward(v: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """C8 exactly, for at most `most` vectors: (vec_id, label): merges the two clusters whose union adds least
    squared distance, until k remain; labels by smallest id. In one task; more vectors are refused."""
    if v.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors; use agglomerative()")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        n, size, group = len(x), np.ones(len(x)), [[i] for i in range(len(x))]
        d = ((x[:, None] - x[None]) ** 2).sum(2) / 2 if n <= 400 else np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0) / 2
        np.fill_diagonal(d, np.inf)
        for _ in range(max(0, n - k)):
            i, j = np.unravel_index(np.argmin(d), d.shape)
            i, j = min(i, j), max(i, j)
            t = size[i] + size[j] + size
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / t
            d[i], d[:, i] = new, new
            d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
            size[i] += size[j]
            group[i] += group[j]
            group[j] = []
        label = np.zeros(n, np.int64)
        for no, g in enumerate(g for g in group if g):
            label[g] = no
        return pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "label": label})

    return v.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").groupBy(F.lit(1).alias("one")).applyInPandas(lambda p: run(p), "vec_id long, label long")


def density_clusters(v: DataFrame, threshold: float, min_size: int = 15, min_neighbours: int = 2) -> DataFrame:
    """C10, own: (vec_id, label): vectors with `min_neighbours` others at `threshold` similarity are cores;
    linked cores form a cluster, others join their most similar core; clusters below `min_size` and
    the rest are noise (-1). A density clustering at one level, standing in for a hierarchy of levels."""
    from corpusmill.operators.graph import connected_components

    p = written(inner_products_within(v, least=threshold).where("a_id <> b_id"), "near")
    core = p.groupBy("a_id").count().where(F.col("count") >= min_neighbours).select(F.col("a_id").alias("core"))
    links = p.join(core.withColumnRenamed("core", "a_id"), "a_id", "left_semi").join(core.withColumnRenamed("core", "b_id"), "b_id", "left_semi")
    comp = connected_components(links.union(core.select(F.col("core").alias("a_id"), F.col("core").alias("b_id"), F.lit(1.0).alias("ip")).select(links.columns)), "a_id", "b_id")
    border = p.join(comp.withColumnRenamed("node", "b_id"), "b_id").join(comp.select(F.col("node").alias("a_id")), "a_id", "left_anti")
    border = border.groupBy("a_id").agg(F.max_by("component", F.struct("ip", -F.col("b_id"))).alias("component")).withColumnRenamed("a_id", "node")
    m = comp.union(border.select("node", "component"))
    big = m.groupBy("component").count().where(F.col("count") >= min_size).select("component")
    m = m.join(big, "component").select(F.col("node").alias("vec_id"), F.col("component").alias("label"))
    return v.select("vec_id").join(m, "vec_id", "left").na.fill(-1, ["label"])


def cluster_tree(v: DataFrame, k: int, dim: int, max_depth: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """C11: (clusters, members): divided by agglomerative() level by level while above the depth and of more than k
    vectors. clusters: cluster_id, parent_id, level, n, mean; members: cluster_id, level, vec_id, embedding.
    Ids are given by level, then parent, then label. The clusters above a level (at most k to its power)
    are listed at the driver; vectors never are."""
    members = written(v.where(F.col("embedding").isNotNull()).select(F.lit(0).cast("long").alias("cluster_id"), F.lit(0).alias("level"), "vec_id", "embedding"), "level")
    every, tree, last = [members], [(0, None, 0)], 0
    for level in range(max_depth):
        sizes = {r[0]: r[1] for r in members.groupBy("cluster_id").count().collect()}
        parts = []
        for cid in sorted(c for c, n in sizes.items() if n > k):
            m = members.where(F.col("cluster_id") == cid)
            lab = agglomerative(m, k, seed)
            got = m.select("vec_id", "embedding").join(lab, "vec_id")
            found = sorted(r[0] for r in got.select("label").distinct().collect())
            if len(found) < 2:
                continue
            ids = {lb: last + 1 + i for i, lb in enumerate(found)}
            last += len(found)
            tree += [(i, cid, level + 1) for i in ids.values()]
            code = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
            parts.append(got.select(code[F.col("label")].cast("long").alias("cluster_id"), F.lit(level + 1).alias("level"), "vec_id", "embedding"))
        if not parts:
            break
        nxt = parts[0]
        for p in parts[1:]:
            nxt = nxt.union(p)
        members = written(nxt, "level")
        every.append(members)
    whole = every[0]
    for m in every[1:]:
        whole = whole.union(m)
    nodes = v.sparkSession.createDataFrame(tree, "cluster_id long, parent_id long, level int")
    return nodes.join(group_means(whole, "cluster_id", dim), "cluster_id"), whole


def tree_scores(members: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """C11: (cluster_id, silhouette, davies_bouldin, calinski_harabasz) of each divided cluster over its children, as
    in C12; children of the same mean add nothing to Davies-Bouldin, no spread within gives a Calinski-Harabasz of 1."""
    kids = clusters.where("parent_id IS NOT NULL").select("cluster_id", "parent_id")
    m = members.join(kids, "cluster_id")
    c = m.groupBy("parent_id", "cluster_id").agg(mean_vector(F.col("embedding"), dim).alias("mean"))
    d = _distance(F.col("embedding"), F.col("mean"))
    s = m.join(c, ["parent_id", "cluster_id"]).groupBy("parent_id", "cluster_id").agg(F.avg(d).alias("s"), F.sum(d * d).alias("w"), F.count("*").alias("n"), F.first("mean").alias("mean"))
    s = written(s, "children")
    o = s.select("parent_id", F.col("cluster_id").alias("c2"), F.col("s").alias("s2"), F.col("mean").alias("m2"))
    apart = _distance(F.col("mean"), F.col("m2"))
    r = s.join(o, "parent_id").where("cluster_id <> c2").groupBy("parent_id", "cluster_id").agg(F.max(F.when(apart == 0, 0.0).otherwise((F.col("s") + F.col("s2")) / apart)).alias("r"))
    r = r.groupBy("parent_id").agg(F.avg("r").alias("davies_bouldin"))
    g = m.groupBy("parent_id").agg(mean_vector(F.col("embedding"), dim).alias("g"))
    to_g = _distance(F.col("mean"), F.col("g"))
    ch = s.join(g, "parent_id").groupBy("parent_id").agg(F.sum(F.col("n") * to_g * to_g).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("t"), F.count("*").alias("k"))
    ch = ch.select("parent_id", F.when(F.col("w") == 0, 1.0).otherwise(F.col("b") * (F.col("t") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))
    si = silhouette(m.select("parent_id", F.col("cluster_id").alias("label"), "vec_id", "embedding"), by="parent_id")
    return si.join(r, "parent_id").join(ch, "parent_id").withColumnRenamed("parent_id", "cluster_id")


def pca_reduced(v: DataFrame, dim: int, cutoff: float = 0.7) -> tuple[DataFrame, int]:
    """(vec_id, reconstructed, scores) and the number of components: the fewest whose share of the variance
    is above `cutoff`; vectors centred, projected and projected back, both at unit length. Moments are
    aggregates of dim * dim numbers; the eigenvectors are found at the driver, signs made positive at
    their largest place."""
    rows = v.where(F.col("embedding").isNotNull()).select("vec_id", doubles(F.col("embedding")).alias("x"))

    def moments(it):
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for p in it:
            if len(p):
                x = np.stack(p["x"].to_numpy())
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    got = rows.mapInPandas(moments, "n long, s array<double>, q array<double>").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"), F.array(*[F.sum(F.get("q", F.lit(i))) for i in range(dim * dim)]).alias("q") if dim <= 16 else F.lit(None).alias("q"))
    if dim <= 16:
        r = got.first()
        n, s, q = r["n"], np.array(r["s"]), np.array(r["q"]).reshape(dim, dim)
    else:  # sums of long arrays one row a task, added at the driver: tasks * dim * dim numbers
        parts = rows.mapInPandas(moments, "n long, s array<double>, q array<double>").collect()
        n, s, q = sum(p["n"] for p in parts), sum(np.array(p["s"]) for p in parts), sum(np.array(p["q"]) for p in parts).reshape(dim, dim)
    mean = s / n
    value, axes = np.linalg.eigh(q / n - np.outer(mean, mean))
    value, axes = value[::-1].clip(0), axes[:, ::-1].T
    axes = axes * np.sign(axes[np.arange(dim), np.abs(axes).argmax(1)])[:, None]
    k = int(np.searchsorted(np.cumsum(value / value.sum()), cutoff, side="right")) + 1
    a = axes[: min(k, dim)]

    def project(it):
        for p in it:
            x = np.stack(p["x"].to_numpy()) - mean if len(p) else np.zeros((0, dim))
            z = x @ a.T
            back = z @ a + mean
            unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
            yield pd.DataFrame({"vec_id": p["vec_id"], "reconstructed": list(unit(back)), "scores": list(unit(z))})

    return rows.mapInPandas(project, "vec_id long, reconstructed array<double>, scores array<double>"), len(a)


def plus_minus_split(scores: DataFrame, depth: int = 3) -> DataFrame:
    """C4: (vec_id, path): by the d-th score above, within or below one population standard deviation of the
    mean of its group, for d up to `depth`; paths of +, 0 and - from the top."""
    out = scores.select("vec_id", "scores", F.lit("").alias("path"))
    for d in range(depth):
        x = F.get("scores", F.lit(d))
        # means and deviations by partial aggregates; at most 4 ** d paths join back
        by = out.groupBy("path").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
        out = out.join(F.broadcast(by), "path")
        m, s = F.col("_m"), F.col("_s")
        out = out.withColumn("path", F.concat("path", F.when(x.isNull(), "").when(x > m + s, "+").when(x < m - s, "-").otherwise("0"))).drop("_m", "_s")
    return out.select("vec_id", "path")


def pca_steps(v: DataFrame, dim: int, w: int = 2, depth: int = 5, cutoff: float = 0.9999, key: str = "doc_id", pos: str = "sent_ind") -> DataFrame:
    """(key, pos, path): vectors (key, pos, embedding) in order averaged over `w` places of their key, turned to
    principal components of unit variance, and divided by plus_minus_split(). A window carries the place of its
    first vector; windows cut off at the end of a key are left out, as are keys shorter than `w`."""
    from corpusmill.operators.windows import window_sums

    order = W.partitionBy(key)
    n = v.where(F.col("embedding").isNotNull())
    n = n.withColumn("vec_id", F.struct(key, pos)).withColumn("_left", F.count("*").over(order) - F.row_number().over(order.orderBy(pos)))
    sums = window_sums(n, w, dim, key, pos).join(n.select(key, pos, "_left"), [key, pos]).where(F.col("_left") >= w - 1)
    smooth = sums.select(F.struct(key, pos).alias("_at"), F.transform("fwd", lambda x: x / w).alias("embedding"))
    smooth = written(smooth.withColumn("vec_id", F.monotonically_increasing_id()), "smooth")
    got, k = pca_reduced(smooth, dim, cutoff)
    spread = got.agg(*[F.stddev_pop(F.get("scores", F.lit(i))).alias(f"s{i}") for i in range(k)])
    one = F.array(*[F.get("scores", F.lit(i)) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(k)])
    paths = plus_minus_split(got.crossJoin(F.broadcast(spread)).select("vec_id", one.alias("scores")), depth)
    return paths.join(smooth.select("vec_id", "_at"), "vec_id").select(F.col(f"_at.{key}"), F.col(f"_at.{pos}"), "path")


def reduced(v: DataFrame, n_components: int, dim: int) -> DataFrame:
    """(vec_id, embedding) with `n_components` places: principal components in place of a manifold
    projection; as it is where it has no more places."""
    from pyspark.ml.feature import PCA

    if dim <= n_components:
        return v.select("vec_id", doubles(F.col("embedding")).alias("embedding"))
    x = _assembled(v)
    return PCA(k=n_components, inputCol="features", outputCol="pc").fit(x).transform(x).select("vec_id", vector_to_array("pc").alias("embedding"))


def most_similar(v: DataFrame, query: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, vec_id, sim, rank): the n most similar to each of a bounded list of queries, by cosine; at
    equal ones (to 9 places) the smaller id. Each batch gives its n best for each query on."""

    def work(ids, x, q, h, m):
        unit = lambda y: y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)
        s = np.round(unit(m) @ unit(x).T, 9)
        top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n] if len(ids) > n else np.broadcast_to(np.arange(len(ids)), s.shape)
        i = np.repeat(np.arange(len(m)), top.shape[1])
        j = top.ravel()
        return pd.DataFrame({"query_id": h["vec_id"].to_numpy()[i], "vec_id": ids[j], "s": s[i, j]})

    p = _against(v, "vec_id", "embedding", _list(query, "vec_id", "embedding"), work, "query_id long, vec_id long, s double")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    return p.withColumn("rank", r.cast("long")).where(F.col("rank") <= n).select("query_id", "vec_id", F.round("s", 6).alias("sim"), "rank")
