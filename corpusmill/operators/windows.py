"""Sliding windows over the sentences of documents: topic distance, extrema, topic changes.

All windows of one size use prefix sums, each place of a vector a column or an array position, and are
partitioned by document, so documents run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot


def window_sums(v: DataFrame, w: int, dim: int, key: str = "doc_id", pos: str = "sent_ind", vec: str = "embedding") -> DataFrame:
    """(key, pos, fwd, back): sums of vectors pos..pos+w-1 and pos-w..pos-1, cut off at the ends;
    none is a zero vector."""
    o = W.partitionBy(key).orderBy(pos)
    f, b = o.rowsBetween(0, w - 1), o.rowsBetween(-w, -1)
    x = [F.get(vec, F.lit(i)).cast("double") for i in range(dim)]
    return v.select(key, pos, F.array(*[F.sum(c).over(f) for c in x]).alias("fwd"), F.array(*[F.coalesce(F.sum(c).over(b), F.lit(0.0)) for c in x]).alias("back"))


def topic_distance(v: DataFrame, w: int, dim: int, key: str = "doc_id", pos: str = "sent_ind", vec: str = "embedding") -> DataFrame:
    """(key, pos, distance): (1 - <fwd, back> / w^2) / 2; sums are divided by w also where cut off."""
    s = window_sums(v, w, dim, key, pos, vec)
    return s.select(key, pos, ((1 - dot(F.col("fwd"), F.col("back")) / (w * w)) / 2).alias("distance"))


def extrema(values: DataFrame, key: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(key, max_pos, max_value, min_pos, min_value); of equal values the first position."""
    return values.groupBy(key).agg(
        F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("max_pos"), F.max(value).alias("max_value"),
        F.min_by(pos, F.struct(F.col(value), F.col(pos))).alias("min_pos"), F.min(value).alias("min_value"))


def window_extrema(values: DataFrame, w: int, key: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(key, max_pos, min_pos): of each window of w values but the last, its extrema, if the maximum lies
    within one of the middle and isn't below the key's mean; each pair once. Positions run from 0."""
    o = W.partitionBy(key).orderBy(pos).rowsBetween(0, w - 1)
    m = W.partitionBy(key)
    z = values.select(
        key, F.col(pos).alias("ii"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col(pos)).alias("p"))).over(o).alias("hi"), F.min(F.struct(F.col(value).alias("v"), F.col(pos).alias("p"))).over(o).alias("lo"),
        F.avg(value).over(m).alias("mean"), F.count("*").over(m).alias("n"))
    at = -F.col("hi.p") - F.col("ii")
    return z.where((F.col("ii") < F.col("n") - w) & (F.abs(at - 0.5 * w) < 1) & (F.col("hi.v") >= F.col("mean"))).select(key, (-F.col("hi.p")).alias("max_pos"), F.col("lo.p").alias("min_pos")).distinct()


def useful_extrema(values: DataFrame, w: int, key: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(key, pos): the maxima of window_extrema(), each once."""
    return window_extrema(values, w, key, pos, value).select(key, F.col("max_pos").alias("pos")).distinct()


def moving_average(values: DataFrame, w: int, key: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(key, pos, mean): means of w values from pos on, only where there are so many. Labelled by the window's start."""
    k = W.partitionBy(key)
    z = values.select(key, pos, F.avg(value).over(k.orderBy(pos).rowsBetween(0, w - 1)).alias("mean"), F.row_number().over(k.orderBy(pos)).alias("_i"), F.count("*").over(k).alias("_n"))
    return z.where(F.col("_i") <= F.col("_n") - w + 1).select(key, pos, "mean")


def _peaks(d: np.ndarray, w: int, mean: float) -> set[int]:
    out = set()
    if len(d) > w:
        view = np.lib.stride_tricks.sliding_window_view(d, w)[: len(d) - w]
        at = view.argmax(1)
        ok = (np.abs(at - 0.5 * w) < 1) & (view.max(1) >= mean)
        out = set((np.arange(len(at)) + at)[ok].tolist())
    return out


def change_counts(v: DataFrame, min_w: int = 3, key: str = "doc_id", pos: str = "sent_ind", vec: str = "embedding") -> DataFrame:
    """(key, pos, cnt): in how many window sizes from `min_w` to below a fifth of the sentences each
    sentence is a useful extremum of the topic distance; 0 where in none (also for documents too short
    for any size).

    The sizes of a document are all taken at its prefix sums, once worked out: O(1) a window. A document
    is the unit of work; its windows depend on all of its sentences."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        x = np.stack([np.asarray(r, float) for r in pdf[vec]])
        n, p = len(x), np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
        i, cnt = np.arange(n), np.zeros(n, np.int64)
        for w in range(min_w, n // 5):
            fwd, back = p[np.minimum(i + w, n)] - p[i], p[i] - p[np.maximum(i - w, 0)]
            d = (1 - np.einsum("ij,ij->i", fwd, back) / (w * w)) / 2
            for k in _peaks(np.round(d, 12), w, round(float(d.mean()), 12)):
                cnt[k] += 1
        return pd.DataFrame({key: pdf[key].to_numpy(), pos: pdf[pos].to_numpy(), "cnt": cnt})

    types = {f.name: f.dataType.simpleString() for f in v.schema}
    return v.where(F.col(vec).isNotNull()).select(key, pos, vec).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {pos} {types[pos]}, cnt long")
