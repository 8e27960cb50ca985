"""Joins in which a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.lineage import written


def hot_keys(counts: DataFrame, key: str, rows: str, share: float = 0.005) -> list:
    """Keys of more than `share` of all rows. At most 1 / share keys can be, so the list is bounded."""
    total = counts.agg(F.sum(rows)).first()[0]
    if not total:
        return []
    return [r[0] for r in counts.where(F.col(rows) > total * share).select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join on `key` (unique in `small`). Rows of `big` with a hot key are spread over `salts`
    parts, to each of which the row of `small` goes; all other keys join as ever."""
    if not hot:
        return big.join(small, key, how)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c != key]), F.lit(salts)).cast("int")
    b = big.withColumn("_salt", F.when(F.col(key).isin(hot), spread).otherwise(F.lit(0)))
    s = small.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return b.join(s, [key, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """salted_join() with the hot keys counted in `big` itself, by partial aggregates."""
    counts = written(big.groupBy(key).agg(F.count("*").alias("_rows")), "keys")
    return salted_join(big, small, key, hot_keys(counts, key, "_rows"), how=how)
