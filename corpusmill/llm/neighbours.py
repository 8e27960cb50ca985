"""The k most similar vectors of every vector.

A tree of spherical k-means centres, fitted on a bounded sample, divides all vectors among its
leaves; it has the more leaves the more vectors there are, so that a leaf holds about LEAF_ROWS of them
(as long as the sample has two rows a leaf). A vector visits leaves best bin first through a priority
queue (see tree.py). The number of visits is calibrated: the neighbours of sampled queries are found by
comparing them with all vectors, and visits are widened until the asked share of those neighbours is
met in a visited leaf. These queries are drawn from all vectors, as those the tree is fitted on lie nearer
to its centres than others do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.clusters import USABLE_SQL
from corpusmill.llm.tree import LEAF_SAMPLE, Tree, best_bins, calibrate, fit_tree, nearest
from corpusmill.llm.vectors import copies, keyed, matrix, representatives, sample, stacked, to_members, usable
from corpusmill.plans.lineage import written

DIM = 64
#: Vectors the tree is fitted on, at most (12 MB of centres in single precision, as each may become a leaf);
#: every vector is put into a leaf.
FIT_ROWS = 49152
#: Vectors the visits are calibrated with, at most.
PROBES = 8192
#: Vectors a leaf should hold.
LEAF_ROWS = 512
#: Rows of a leaf, or queries at a leaf, compared at once.
BLOCK = 8192
#: Leaves of one row set. They lie side by side in the tree, so a row that visits several of them is sent once.
SHARED_LEAVES = 16


def _fit(reps: DataFrame) -> tuple[Tree, np.ndarray]:
    """The tree, and vectors in an order by chance to calibrate it with."""
    n = reps.count()
    x = sample(reps, n, FIT_ROWS, DIM)
    if not len(x):
        return Tree(np.zeros((1, DIM), np.float32), *(np.array([v]) for v in (0, 0, 0, 0.0))), x
    least = max(2, min(LEAF_SAMPLE, LEAF_ROWS * len(x) // n))
    probes = x if n <= FIT_ROWS else sample(reps, n, PROBES, DIM, salt=11)
    return fit_tree(x, least=least), probes[np.random.default_rng(1).permutation(len(probes))]


def _visiting(df: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """(rep, vec, bins) of each row."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                p = b.slice(s, 2048)
                bins = best_bins(tree, matrix(p.column("vec"), DIM), visits)
                yield pa.RecordBatch.from_arrays([p.column("rep"), p.column("vec"), pa.array([x[x >= 0] for x in bins], pa.list_(pa.int32()))], ["rep", "vec", "bins"])

    return df.select("rep", "vec").mapInArrow(run, "rep long, vec array<float>, bins array<int>")


def _large(leaf: DataFrame) -> dict[int, int]:
    """How many parts of at most BLOCK rows the rows of a leaf make, for leaves that make several."""
    return {r["leaf"]: math.ceil(r["count"] / BLOCK) for r in leaf.groupBy("leaf").count().where(F.col("count") > BLOCK).collect()}  # a row a leaf at most


def _parts(large: dict[int, int]):
    """Column: the parts of a leaf."""
    return F.coalesce(F.create_map(*[F.lit(y) for kv in large.items() for y in kv])[F.col("leaf")], F.lit(1)) if large else F.lit(1)


def _all(n):
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _own(n):
    return F.pmod(F.xxhash64("rep"), n).cast("int")


def _compare(q: pd.DataFrame, v: pd.DataFrame, k: int, least: float | None) -> pd.DataFrame:
    v = v.sort_values("rep")
    vm, ids, out = stacked(v["vec"], DIM), v["rep"].to_numpy(), [pd.DataFrame({"rep_a": np.zeros(0, np.int64), "rep_b": np.zeros(0, np.int64), "sim": np.zeros(0)})]
    for s in range(0, len(q) if len(v) else 0, 1024):
        p = q.iloc[s : s + 1024]
        i, n, sim = nearest(stacked(p["vec"], DIM), vm, ids, k, least)
        own = p["rep"].to_numpy()[i]
        keep = own != n
        out.append(pd.DataFrame({"rep_a": own[keep], "rep_b": n[keep], "sim": sim[keep]}))
    return pd.concat(out)


_PAIRS = "rep_a long, rep_b long, sim double"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    # one shuffle: a pair met in several leaves has one rank, and its copies then lie in one partition
    best = pairs.withColumn("r", F.dense_rank().over(W.partitionBy("rep_a").orderBy(F.desc("sim"), "rep_b"))).where(F.col("r") <= k)
    return best.select("rep_a", "rep_b", "sim").distinct()


def search(reps: DataFrame, queries: DataFrame, k: int, least: float | None, recall: float) -> DataFrame:
    """(rep_a, rep_b, sim): the k - 1 best others of `reps` for each row of `queries`. Every row of
    `reps` lies in its first leaf, the queries go to all leaves they visit. A leaf or a list of queries
    of more than BLOCK rows is divided, and every part of the rows meets every part of the queries."""
    tree, probes = _fit(reps)
    visits = calibrate(reps, probes, tree, k - 1, least, recall, False) if len(probes) else 1
    rows = written(_visiting(reps, tree, 1), "rows").select("rep", "vec", F.explode("bins").alias("leaf"))
    asks = written(_visiting(queries, tree, visits), "asks").select("rep", "vec", F.explode("bins").alias("leaf"))
    pr, pq = _parts(_large(rows)), _parts(_large(asks))
    a = rows.withColumn("i", _own(pr)).withColumn("j", _all(pq))
    b = asks.withColumn("j", _own(pq)).withColumn("i", _all(pr))
    met = a.groupBy("leaf", "i", "j").cogroup(b.groupBy("leaf", "i", "j")).applyInPandas(lambda v, q: _compare(q, v, k, least), _PAIRS)
    return _best(met, k - 1)


def _shared(rows: DataFrame, large: dict[int, int]) -> DataFrame:
    """(bucket, leaves, rep, vec): each row of `rows` (rep, vec, bins) once for each SHARED_LEAVES neighbouring leaves
    of which it visits any, with those of them it visits; leaves in `large` are left out."""
    small = F.filter("bins", lambda x: ~x.isin(*large)) if large else F.col("bins")
    bucket = lambda x: F.floor(x / SHARED_LEAVES).cast("int")
    rows = rows.select("rep", "vec", small.alias("bins"))
    rows = rows.select("rep", "vec", "bins", F.explode(F.array_distinct(F.transform("bins", bucket))).alias("bucket"))
    return rows.select("bucket", F.filter("bins", lambda x: bucket(x) == F.col("bucket")).alias("leaves"), "rep", "vec")


def search_all(reps: DataFrame, k: int, least: float | None, recall: float) -> DataFrame:
    """The same with every row of `reps` as a query. A row is both searched for and found in each leaf it visits; it
    is sent once to all those that share a row set. Parts of a large leaf meet two by two."""
    tree, probes = _fit(reps)
    visits = calibrate(reps, probes, tree, k - 1, least, recall, True) if len(probes) else 1
    visiting = _visiting(reps, tree, visits)
    rows = visiting.select("rep", "vec", F.explode("bins").alias("leaf"))
    large = _large(rows)

    def meet_leaves(p: pd.DataFrame) -> pd.DataFrame:
        at = np.repeat(np.arange(len(p)), p["leaves"].map(len))
        leaf = np.concatenate(list(p["leaves"]))
        parts = [p.iloc[at[leaf == x]] for x in np.unique(leaf)]
        return pd.concat([_compare(x, x, k, least) for x in parts])

    met = _shared(visiting, large).groupBy("bucket").applyInPandas(meet_leaves, _PAIRS)
    if not large:
        return _best(met, k - 1)
    n = _parts(large)
    rows = rows.where(F.col("leaf").isin(*large)).withColumn("own", _own(n)).withColumn("o", _all(n)).select("leaf", "rep", "vec", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iat[0], p["j"].iat[0]
        if i == j:
            return _compare(p, p, k, least)
        x, y = p[p["own"] == i], p[p["own"] == j]
        return pd.concat([_compare(x, y, k, least), _compare(y, x, k, least)])

    return _best(met.union(rows.groupBy("leaf", "i", "j").applyInPandas(meet, _PAIRS)), k - 1)


def neighbours(rec: DataFrame, k: int = 10, least: float | None = None, recall: float = 0.97, every: int | None = None) -> DataFrame:
    """(id, best): for each record that counts (with `every`: whose id is divisible by it) the list of its
    up to k most similar other records as (sim, id), best first, at equal similarity the smaller id first;
    with `least`, of those at that similarity or more. `recall` is the share of them that must be met.

    Exact copies are searched for once. A group of copies stands in the lists with its k + 1 smallest
    ids, which is all a list of k can hold of it. An empty table gives no rows."""
    vecs = keyed(written(usable(rec, DIM), "vectors"))
    copy = copies(vecs)
    reps = representatives(vecs, copy)
    asked = vecs if every is None else vecs.where(F.pmod("id", F.lit(every)) == 0)
    if every is None:
        found = written(search_all(reps, k + 1, least, recall), "found")
    else:
        found = written(search(reps, reps.join(asked.select("key").distinct(), "key", "left_semi"), k + 1, least, recall), "found")
    # the smallest ids of each group of copies; window limits are applied before the shuffle
    small = to_members(vecs.select("key", "id"), copy.select("key", "rep"), copy)
    small = small.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # a copy's own group belongs to its list, at similarity 1; other representatives are alone
    found = found.union(copy.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("sim")))
    few = found.join(small.withColumnRenamed("rep", "rep_b"), "rep_b", "left").select("rep_a", "sim", F.explode(F.coalesce("ids", F.array("rep_b"))).alias("id"))
    few = few.withColumn("r", F.row_number().over(W.partitionBy("rep_a").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k + 1)
    lists = few.groupBy("rep_a").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "sim", "id"))), lambda x: F.struct(x["sim"].alias("sim"), x["id"].alias("id"))).alias("best"))
    lists = written(lists, "lists")
    # copies take the list of their representative, any other record its own
    of_copies = to_members(asked.select("key", "id"), copy.select("key", "rep"), copy).join(lists, F.col("rep") == F.col("rep_a")).select("id", "best")
    alone = lists.join(copy.select("rep"), F.col("rep") == F.col("rep_a"), "left_anti").select(F.col("rep_a").alias("id"), "best")
    return of_copies.union(alone).select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))


def p4_neighbours(spark, d):
    """The ten most similar records of every record whose id is divisible by 100, against all records."""
    n = neighbours(spark.read.parquet(f"{d}/cluster_rec.parquet"), 10, every=100)
    n = n.select("id", F.posexplode("best").alias("p", "x"))
    return n.select(F.col("id").alias("cluster_id"), (F.col("p") + 1).cast("long").alias("rank"), F.col("x.id").alias("neighbour_id"), F.round((1 + F.col("x.sim")) / 2, 4).alias("similarity"))


def p4_found(spark, d):
    n = neighbours(spark.read.parquet(f"{d}/cluster_rec.parquet"), 5, least=0.8, recall=0.9985)
    n = n.where(F.size("best") >= 5).select("id", F.explode("best.id").alias("o"))
    return n.select(F.least("id", "o").alias("cluster_id_a"), F.greatest("id", "o").alias("cluster_id_b")).distinct()


SQL = {
    "p4_found": f"""WITH {USABLE_SQL},
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM ok a JOIN ok b ON a.id <> b.id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn, count(*) OVER (PARTITION BY a) AS n FROM s WHERE sim >= 0.8)
SELECT DISTINCT least(a, b) AS cluster_id_a, greatest(a, b) AS cluster_id_b FROM r WHERE rn <= 5 AND n >= 5"""
}

QUERIES = {"p4_neighbours": p4_neighbours, "p4_found": p4_found}
