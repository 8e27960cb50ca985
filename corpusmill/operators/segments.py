"""Topic trees of documents: built from change counts, annotated with terms and vectors.

A tree is a table (doc_id, node_id, parent_node_id, level, path, start_at, end_at). Depth is bounded by
the tree, so rollups join each node to its ancestors along `path` in place of a loop.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot, doubles, l2_normalize, mean_vector, similarity
from corpusmill.plans.skew import spread_join


def _split(counts: list[float], least: int) -> dict:
    """Node over positions 0.. with its children: divided at the first largest count (not at 0)."""
    root = {"level": 0, "start": 0, "end": len(counts) - 1, "children": []}
    todo = [(root, counts)]
    while todo:
        node, c = todo.pop()
        if len(c) < 2:
            continue
        at = max(range(len(c)), key=lambda i: (c[i], -i))
        if at == 0:
            at = max(range(1, len(c)), key=lambda i: (c[i], -i))
        s = node["start"]
        for a, b in ((0, at), (at, len(c))):
            # the divider begins the right side
            if b - a >= least:
                kid = {"level": node["level"] + 1, "start": s + a, "end": s + b - 1, "children": []}
                node["children"].append(kid)
                todo.append((kid, c[a:b]))
    return root


def _simplified(node: dict, level: int) -> dict:
    """An only child gives way to its children; children in order, stretched over their parent."""
    stack = [(node, level)]
    while stack:
        n, lv = stack.pop()
        n["level"] = lv
        while len(n["children"]) == 1:
            n["children"] = n["children"][0]["children"]
        n["children"].sort(key=lambda x: x["start"])
        if n["children"]:
            n["children"][0]["start"] = n["start"]
            n["children"][-1]["end"] = n["end"]
            for a, b in zip(n["children"], n["children"][1:]):
                a["end"] = b["start"] - 1
        stack += [(k, lv + 1) for k in n["children"]]
    return node


def segment_tree(counts: DataFrame, key: str = "doc_id", pos: str = "sent_ind", min_node_size: int = 2) -> DataFrame:
    """The topic tree of each document from its change counts (every position present).

    A node is divided at the first position of the largest count (if that is its first, of the largest of
    the rest); a side shorter than `min_node_size` is left out and its sibling takes its place, so a
    node has no children or two, which tile it. Ids are pre-order from 1, the root's parent is 0, path
    is the ids from the root. A document is the unit of work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        first = int(pdf[pos].iat[0])
        root = _simplified(_split(pdf["cnt"].astype(float).tolist(), min_node_size), 0)
        rows, todo, no = [], [(root, 0, "")], 0
        while todo:
            n, parent, path = todo.pop()
            no += 1
            path = f"{path}-{no}" if path else str(no)
            rows.append((no, parent, n["level"], path, first + n["start"], first + n["end"]))
            todo += [(k, no, path) for k in reversed(n["children"])]
        out = pd.DataFrame(rows, columns=["node_id", "parent_node_id", "level", "path", "start_at", "end_at"])
        out.insert(0, key, pdf[key].iat[0])
        return out

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, pos, "cnt").groupBy(key).applyInPandas(run, f"{key} {kind}, node_id long, parent_node_id long, level int, path string, start_at long, end_at long")


def numbered(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """D4 on any nested segments: pre_order from 1 within the document, by start, then level."""
    return nodes.withColumn("pre_order", F.row_number().over(W.partitionBy(key).orderBy("start_at", "level", "node_id")).cast("long"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return nodes.join(nodes.select(F.col("parent_node_id").alias("node_id"), *([] if "doc_id" not in nodes.columns else ["doc_id"])).distinct(), ["node_id"] + (["doc_id"] if "doc_id" in nodes.columns else []), "left_anti")


def leaf_term_counts(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """A11 at the leaves: (doc_id, node_id, term, cnt): sentences of each leaf that hold the term. `places`
    (doc_id, sent_ind, term) are joined on the document, then on the leaf's span."""
    p = places.select("doc_id", "sent_ind", "term").distinct()
    j = leaves(nodes).select("doc_id", "node_id", "start_at", "end_at").join(p, "doc_id").where(F.col("sent_ind").between(F.col("start_at"), F.col("end_at")))
    return j.groupBy("doc_id", "node_id", "term").agg(F.count("*").alias("cnt"))


def closure(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor): each node with itself and all above, from the ids in its path."""
    return nodes.select("doc_id", "node_id", F.explode(F.transform(F.split("path", "-"), lambda x: x.cast("long"))).alias("ancestor"))


def span_closure(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor) of nested segments by their spans, where path holds no ids. Joined on the
    document; a node is its own ancestor."""
    a = nodes.select("doc_id", F.col("node_id").alias("ancestor"), F.col("start_at").alias("s"), F.col("end_at").alias("e"), F.col("level").alias("lv"))
    return nodes.select("doc_id", "node_id", "start_at", "end_at", "level").join(a, "doc_id").where("s <= start_at AND end_at <= e AND lv <= level AND (lv < level OR ancestor = node_id)").select("doc_id", "node_id", "ancestor")


def rolled_up(leaf_counts: DataFrame, above: DataFrame) -> DataFrame:
    """(doc_id, node_id, term, cnt, scaled): counts of the leaves added up to all nodes above; scaled is
    the count over the node's largest. Nodes without a term have no row."""
    r = leaf_counts.join(above, ["doc_id", "node_id"]).groupBy("doc_id", F.col("ancestor").alias("node_id"), "term").agg(F.sum("cnt").alias("cnt"))
    top = r.groupBy("doc_id", "node_id").agg(F.max("cnt").alias("_m"))
    return r.join(top, ["doc_id", "node_id"]).select("doc_id", "node_id", "term", "cnt", (F.col("cnt") / F.col("_m")).alias("scaled"))


def augmented_counts(counts: DataFrame, sub: DataFrame) -> DataFrame:
    """A11, augmented: (doc_id, node_id, term, cnt, augmented): a term's own count, and one for each term of
    the node that holds it; a held term without a count of its own starts at the count of the first that
    holds it (in order of term). `sub` is (term, subterm)."""
    held = spread_join(counts.select("doc_id", "node_id", "term", "cnt"), sub.groupBy("term").agg(F.collect_list("subterm").alias("_s")), "term")  # a term has few sub-terms
    held = held.withColumn("subterm", F.explode("_s")).groupBy("doc_id", "node_id", F.col("subterm").alias("term")).agg(F.count("*").alias("extra"), F.min_by("cnt", "term").alias("from_first"))
    j = counts.select("doc_id", "node_id", "term", "cnt").join(held, ["doc_id", "node_id", "term"], "full")
    return j.select("doc_id", "node_id", "term", F.coalesce("cnt", F.lit(0)).alias("cnt"), (F.coalesce("cnt", "from_first") + F.coalesce("extra", F.lit(0))).cast("double").alias("augmented"))


def sibling_tf_idf(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, term, tf_idf): tf the count over the node's largest, idf ln(siblings / siblings with the
    term), siblings the children of one parent; roots have none. `counts` is (node_id, term, cnt)."""
    n = nodes.where("parent_node_id IS NOT NULL AND parent_node_id <> 0").select("node_id", "parent_node_id").distinct()
    c = counts.join(n, "node_id")
    top = c.groupBy("node_id").agg(F.max("cnt").alias("_m"))
    df = c.groupBy("parent_node_id", "term").agg(F.count("*").alias("_d"))
    size = n.groupBy("parent_node_id").agg(F.count("*").alias("_n"))
    j = c.join(top, "node_id").join(df, ["parent_node_id", "term"]).join(size, "parent_node_id")
    return j.select("node_id", "term", (F.col("cnt") / F.col("_m") * F.ln(F.col("_n") / F.col("_d"))).alias("tf_idf"))


def node_means(nodes: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(doc_id, node_id, mean): the unit mean of the sentence vectors of each node's span."""
    j = nodes.select("doc_id", "node_id", "start_at", "end_at").join(vectors.select("doc_id", "sent_ind", "embedding"), "doc_id").where(F.col("sent_ind").between(F.col("start_at"), F.col("end_at")))
    return j.groupBy("doc_id", "node_id").agg(mean_vector(F.col("embedding"), dim).alias("m")).select("doc_id", "node_id", l2_normalize(F.col("m")).alias("mean"))


def alternative_means(nodes: DataFrame, means: DataFrame, dim: int, most_levels: int = 200) -> DataFrame:
    """(doc_id, node_id, alt_mean): at leaves the mean, above the unit mean of the children's. One step a
    level, from the deepest up; only the depth reaches the driver."""
    from corpusmill.plans.lineage import written

    tree = written(nodes.select("doc_id", "node_id", "parent_node_id", "level").join(means, ["doc_id", "node_id"]), "tree")
    depth = tree.agg(F.max("level")).first()[0]
    inner = tree.select("doc_id", F.col("parent_node_id").alias("node_id")).distinct()
    leaves = tree.join(inner, ["doc_id", "node_id"], "left_anti").withColumnRenamed("mean", "alt_mean")
    done, below = leaves, leaves.where(F.col("level") == depth)
    for level in range((depth or 0) - 1, -1, -1):
        if level >= most_levels:
            raise ValueError("the tree is too deep")
        kids = below.groupBy("doc_id", F.col("parent_node_id").alias("node_id")).agg(mean_vector(F.col("alt_mean"), dim).alias("m"))
        here = tree.where(F.col("level") == level).drop("mean").join(kids, ["doc_id", "node_id"]).withColumn("alt_mean", l2_normalize(F.col("m"))).drop("m")
        here = written(here.select(done.columns), "alt")  # each level is written once, with its own nodes only
        done = done.union(here)
        below = here.union(leaves.where(F.col("level") == level))
    return done.select("doc_id", "node_id", "alt_mean")


def term_similarities(node_terms: DataFrame, node_vectors: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """node_terms (node_id, term) with sim_to_mean, the scaled similarity of the term's vector to the
    node's `mean`, rounded to 4. Vectors of neither side drop the row."""
    j = spread_join(node_terms.join(node_vectors.select("node_id", "mean"), "node_id"), term_vectors.select("term", "embedding"), "term")
    return j.withColumn("sim_to_mean", F.round(similarity(F.col("embedding"), F.col("mean")), 4)).drop("mean", "embedding")


def parent_similarities(node_terms: DataFrame, nodes: DataFrame, node_vectors: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """node_terms with sim_to_parent: their similarity to the parent's vector; roots have no row."""
    up = nodes.where("parent_node_id IS NOT NULL").select("node_id", "parent_node_id").distinct()
    v = node_vectors.select(F.col("node_id").alias("parent_node_id"), "mean")
    j = spread_join(node_terms.join(up, "node_id").join(v, "parent_node_id"), term_vectors.select("term", "embedding"), "term")
    return j.withColumn("sim_to_parent", F.round(similarity(F.col("embedding"), F.col("mean")), 4)).drop("mean", "embedding", "parent_node_id")


def attribute_ranks(attributes: DataFrame) -> DataFrame:
    """(node_id, term_ind) with three ranks: by tf_idf * sim_alt, then sim_alt; by sim_alt; by sim_alt *
    ln(count). Each takes over the order of the one before on ties; the first falls back on term_ind.
    Null measures rank last."""
    a = F.round(F.col("tf_idf_rel_siblings") * F.col("sim_to_alt_mean"), 9)
    s = F.col("sim_to_alt_mean")
    w = W.partitionBy("node_id")
    z = attributes.withColumn("rank_tf_idf", F.row_number().over(w.orderBy(a.desc_nulls_last(), s.desc_nulls_last(), "term_ind")).cast("long"))
    z = z.withColumn("rank_sim", F.row_number().over(w.orderBy(s.desc_nulls_last(), "rank_tf_idf")).cast("long"))
    return z.withColumn("rank_sim_count", F.row_number().over(w.orderBy(F.round(s * F.ln("ATE_count"), 9).desc_nulls_last(), "rank_sim")).cast("long"))


def top_terms(ranked: DataFrame, n: int = 10, rank: str = "rank_sim") -> DataFrame:
    """T5: the first n of each node."""
    return ranked.where(F.col(rank) <= n)


def tree_lines(nodes: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """K8: nodes in order with share (of the parent's length, rounded to 4), and with `means` (node_id, mean)
    sim_to_parent and sim_to_previous (sibling), rounded to 4; null where there is none."""
    n = nodes.withColumn("_len", F.col("end_at") - F.col("start_at") + 1)
    p = n.select(F.col("node_id").alias("parent_node_id"), F.col("_len").alias("_plen"))
    z = n.join(p, "parent_node_id", "left").withColumn("share", F.round(F.col("_len") / F.col("_plen"), 4))
    if means is not None:
        pm = means.select(F.col("node_id").alias("parent_node_id"), F.col("mean").alias("_pm"))
        z = z.join(means.select("node_id", "mean"), "node_id", "left").join(pm, "parent_node_id", "left")
        z = z.withColumn("_prev", F.lag("mean").over(W.partitionBy("doc_id", "parent_node_id").orderBy("start_at", "node_id")))
        z = z.withColumn("sim_to_parent", F.round(similarity(F.col("mean"), F.col("_pm")), 4)).withColumn("sim_to_previous", F.when(F.col("parent_node_id").isNotNull(), F.round(similarity(F.col("mean"), F.col("_prev")), 4))).drop("mean", "_pm", "_prev")
    return z.drop("_len", "_plen")
