"""Rows of attribute_rec that count, one row per node and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_term(c: Column) -> Column:
    """Lower case, no outer spaces, each inner run of spaces as one."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def counting_rows(rec: DataFrame) -> DataFrame:
    """(node_id, term, cnt) of the rows of `rec` that count.

    Of several rows with one (node_id, term_ind), the one with the latest loaded_at is kept (at equal
    loaded_at the larger count, then the later term; a null loaded_at is the earliest); of those, rows
    with a null node_id or ATE_count, or a null or blank term, don't count. The maximum is taken by
    partial aggregates, so a key with many loads never gathers in one task. Other columns of `rec`
    are ignored.
    """
    last = rec.groupBy("node_id", "term_ind").agg(F.max(F.struct("loaded_at", "ATE_count", "term")).alias("m"))
    return (
        last.select("node_id", clean_term(F.col("m.term")).alias("term"), F.col("m.ATE_count").cast("long").alias("cnt"))
        .where(F.col("node_id").isNotNull() & F.col("cnt").isNotNull() & (F.col("term") != ""))
    )


#: The same rows in SQL, as a common table expression.
COUNTING_SQL = """
last AS (
  SELECT node_id, term, ATE_count FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id, term_ind ORDER BY loaded_at DESC NULLS LAST, ATE_count DESC NULLS LAST, term DESC NULLS LAST) AS rn
    FROM attribute_rec) WHERE rn = 1),
rows_ AS (
  SELECT node_id, lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term, CAST(ATE_count AS BIGINT) AS cnt
  FROM last WHERE node_id IS NOT NULL AND ATE_count IS NOT NULL AND trim(regexp_replace(term, '\\s+', ' ', 'g')) <> '')
"""
