"""Connected components of an undirected graph given as an edge table (V1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.lineage import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every end of an edge; component is the smallest node of its component.

    Edges with a null end are left out; self-loops make a component of one. Alternating star
    contraction: each round hangs the larger neighbours of every node on its smallest, then the
    others; the number of edges doesn't grow and the rounds grow with the logarithm of the longest
    path. Only edge counts and a checksum reach the driver. Raises if `rounds` don't suffice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    links = e.where("u <> v")
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours go to the smallest of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = written(small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.join(links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")
