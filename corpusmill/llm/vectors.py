"""Vectors of records: the rows that count, exact copies as one representative, arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.lineage import written
from corpusmill.plans.skew import hot_keys, salted_join


def usable(rec: DataFrame, dim: int = 64) -> DataFrame:
    """(id, num_vectors, vec) of the records of cluster_rec that count.

    Of several rows of one cluster_id the one with the latest loaded_at is kept (at equal loaded_at
    the larger num_vectors, then the larger vector; nulls first); of those only a mean_vec of `dim`
    finite numbers, not all zero, and a cluster_id that isn't null.
    """
    rec = rec.where("cluster_id IS NOT NULL")
    # only ids with several rows are shuffled with their vectors
    again = written(rec.groupBy("cluster_id").count().where("count > 1").select("cluster_id"), "again")
    last = rec.join(again, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.max(F.struct("loaded_at", "num_vectors", "mean_vec")).alias("m"))
    rows = rec.join(again, "cluster_id", "left_anti").select("cluster_id", "num_vectors", "mean_vec").union(last.select("cluster_id", "m.num_vectors", "m.mean_vec"))
    v = F.col("vec")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        rows.select(F.col("cluster_id").alias("id"), "num_vectors", F.col("mean_vec").cast("array<float>").alias("vec"))
        .where((F.size("vec") == dim) & good)
    )


def keyed(vecs: DataFrame) -> DataFrame:
    """`vecs` with a column `key` that is equal for exact copies: 96 bits of two hashes. It is worked out where it is
    used, as it would take more room in a table than it saves."""
    return vecs.withColumn("key", F.xxhash64("vec").cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + F.hash("vec").cast("decimal(10,0)"))


def copies(vecs: DataFrame) -> DataFrame:
    """(key, rep, n) of the groups of more than one exact copy; rep is the smallest id of the group."""
    return written(vecs.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")


def representatives(vecs: DataFrame, copy: DataFrame) -> DataFrame:
    """(key, rep, vec): the record of the smallest id of each group of exact copies, rep its id."""
    return vecs.join(copy.select("key", F.col("rep").alias("_r")), "key", "left").where("_r IS NULL OR _r = id").select("key", F.col("id").alias("rep"), "vec")


def to_members(vecs: DataFrame, per_key: DataFrame, copy: DataFrame, how: str = "inner") -> DataFrame:
    """The columns of `per_key` (unique key) beside each record of `vecs`; large groups of copies are salted."""
    return salted_join(vecs, per_key, "key", hot_keys(copy, "key", "n"), how=how)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column of `dim` numbers each as a float64 matrix with rows of length one."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stacked(series, dim: int) -> np.ndarray:
    """The same from a pandas column of arrays."""
    x = np.concatenate(list(series)).astype(np.float64).reshape(-1, dim) if len(series) else np.zeros((0, dim))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sample(reps: DataFrame, n: int, most: int, dim: int, salt: int = 7) -> np.ndarray:
    """Unit vectors of about `most` of the `n` representatives, and no more (a documented bound): those whose
    key's hash falls below a threshold, so nothing is sorted or shuffled; all of them where they are fewer. Another
    `salt` gives other ones."""
    part = reps.select("rep", "vec")
    if n > most:
        part = reps.where(F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * 0.97 * most / n)).select("rep", "vec")
    got = part.toArrow().sort_by("rep").slice(0, most)
    return matrix(got.column("vec").combine_chunks(), dim) if got.num_rows else np.zeros((0, dim))


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 8, weight: np.ndarray | None = None) -> np.ndarray:
    """Spherical k-means with k-means++ seeds on a bounded matrix; at most k unit centres."""
    rng, w = np.random.default_rng(seed), np.ones(len(x)) if weight is None else weight.astype(float)
    centre = [int(rng.choice(len(x), p=w / w.sum()))]
    near = 1 - x @ x[centre[0]]
    while len(centre) < min(k, len(x)):
        p = w * np.maximum(near, 0)
        if p.sum() <= 1e-9:
            break
        centre.append(int(rng.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, 1 - x @ x[centre[-1]])
    c = x[centre].copy()
    for _ in range(rounds):
        at = (x.astype(np.float32) @ c.T.astype(np.float32)).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, at, x * w[:, None])
        n = np.sqrt((s * s).sum(1))
        c = np.where((n > 1e-12)[:, None], s / np.maximum(n, 1e-12)[:, None], c)
    return c
