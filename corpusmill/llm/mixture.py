"""A mixture of sources in which each has its target share of the tokens.

Systematic sampling: the expected copies of a source's documents are added up along a fixed order, one
random offset a source is added, and a copy is given out for each integer boundary crossed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.tokens import counted
from corpusmill.plans.lineage import written

#: Documents of one block of the running sum, about.
BLOCK_ROWS = 100_000


def _name(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def rates(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, size, rate) of each source of `weights`.

    rate is the expected copies of each document: target_share * total / size, at most max_repeats. The
    target shares are scaled to a sum of one over all sources of `weights`. `total_tokens` is the size
    asked for, by default that of nearest_total(). With a larger one a source that can't fill its share falls
    short of it, and its part isn't given to others, which would take these further off. Null shares count
    as 0, null repeats as 1; a source without documents has rate 0.
    """
    w = weights.select(_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    w = w.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = w.join(sizes, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "size": F.coalesce("size", F.lit(0)), "spread": F.coalesce("spread", F.lit(0.0))})
    j = j.crossJoin(F.broadcast(j.agg(F.sum("target_share").alias("_w")))).withColumn("share", F.when(F.col("_w") > 0, F.col("target_share") / F.col("_w")).otherwise(0.0))
    total = F.lit(total_tokens) if total_tokens is not None else F.col("_t")
    j = j.crossJoin(F.broadcast(nearest_total(j))) if total_tokens is None else j
    rate = F.when(F.col("size") > 0, F.least(F.col("share") * total / F.col("size"), F.col("max_repeats").cast("double")))
    return j.select("source", F.col("share").alias("target_share"), "max_repeats", "docs", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def nearest_total(sources: DataFrame) -> DataFrame:
    """One row (_t): the size of the mixture at which its shares are expected to come nearest their targets.

    A large total leaves capped sources short of their share; a small one is made of so few documents that one
    more or less, which a source's spread of sizes measures, moves the shares. Of totals from the largest at
    which no source is short up to where all are capped, in steps of a fifth, the one with the least sum of
    both is taken. Works on the few rows of `sources` (source, share, max_repeats, size, spread)."""
    s = sources.where("share > 0 AND size > 0 AND max_repeats > 0")
    lo = s.agg(F.min(F.col("max_repeats") * F.col("size") / F.col("share")).alias("_lo"), F.max(F.col("max_repeats") * F.col("size") / F.col("share")).alias("_hi"))
    steps = lo.select(F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.log(F.col("_hi") / F.col("_lo")) / math.log(1.2)).cast("int")), lambda k: F.col("_lo") * F.pow(F.lit(1.2), k))).alias("_t"))
    got = s.crossJoin(F.broadcast(steps)).withColumn("got", F.least(F.col("share") * F.col("_t"), F.col("max_repeats") * F.col("size").cast("double")))
    sums = got.groupBy("_t").agg(F.sum("got").alias("all"))
    off = got.join(sums, "_t").groupBy("_t").agg(F.sum(F.abs(F.col("got") / F.col("all") - F.col("share")) + F.col("spread") / F.col("all")).alias("off"))
    return off.agg(F.coalesce(F.min(F.struct("off", "_t"))["_t"], F.lit(0.0)).alias("_t"))


def sampled(docs: DataFrame, rate: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copy_no): each copy of each document, `docs` having doc_id, source, tokens.

    The order of the running sum is by size class, then a part by hash, then tokens and doc_id, so the
    copies taken of a source have its mix of sizes and their tokens come close to the expected. Sums of
    the blocks are added up first (a few hundred rows a source and 100,000 documents), then the rows
    within each block, so a source of any size is spread over many tasks. A document's copies are
    floor(sum up to it + offset) less floor(sum before it + offset): within one of its rate.
    """
    n = docs.count()
    parts = max(1, n // BLOCK_ROWS)
    e = docs.join(rate.select("source", "rate"), "source").where("rate > 0")
    e = e.withColumn("block", F.floor(F.log2(F.col("tokens") + 1.0) * 4) * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    e = written(e, "expected")
    sums = e.groupBy("source", "block").agg(F.sum("rate").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("s")
    w = W.partitionBy("source", "block").orderBy("tokens", "doc_id")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    # sums of equal rates in a block are a product: no rounding errors pile up
    i = F.row_number().over(w)
    at = e.withColumn("i", i).join(sums, ["source", "block"])
    up = lambda k: F.floor(F.round(F.col("before") + k * F.col("rate") + offset, 7))
    at = at.withColumn("copies", (up(F.col("i")) - up(F.col("i") - 1)).cast("int")).where("copies > 0")
    return at.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def sized(docs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens) of the documents with tokens, and (source, docs, size, spread) of each source.
    Source names are compared without case and outer spaces; a null one belongs to no source."""
    d = counted(docs.select("doc_id", _name(F.col("source")).alias("source"), "text")).where("tokens > 0 AND source IS NOT NULL")
    d = written(d, "counted")
    return d, written(d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("size"), F.stddev_pop("tokens").alias("spread")), "sizes")


def mixture(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copy_no) of the mixture; see rates() and sampled(). Null and empty texts
    have no tokens and are left out. Empty tables give no rows."""
    d, sizes = sized(docs, weights)
    return sampled(d, rates(sizes, weights, total_tokens), seed)


def shares(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """One row per source of `weights`: target_share, max_repeats, its documents and tokens, the copies and
    tokens given out, actual_share of all tokens given out, capped: whether max_repeats bound it, and
    distance: half the sum of all differences between actual and target shares, 0 where all are met."""
    d, sizes = sized(docs, weights)
    rate = written(rates(sizes, weights, total_tokens), "rates")
    got = sampled(d, rate, seed).groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("mix_tokens"))
    j = rate.join(got, "source", "left").withColumns({"copies": F.coalesce("copies", F.lit(0)), "mix_tokens": F.coalesce("mix_tokens", F.lit(0))})
    j = written(j, "shares")
    total = j.agg(F.sum("mix_tokens").alias("_t"))
    share = F.coalesce(F.col("mix_tokens") / F.when(F.col("_t") > 0, F.col("_t")), F.lit(0.0))
    off = j.crossJoin(F.broadcast(total)).agg((F.sum(F.abs(share - F.coalesce("target_share", F.lit(0.0)))) / 2).alias("_d"))
    return j.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(off)).select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats", "docs", F.col("size").alias("source_tokens"), "copies", "mix_tokens",
        F.round(F.col("mix_tokens") / F.when(F.col("_t") > 0, F.col("_t")), 6).alias("actual_share"), (F.col("rate") >= F.col("max_repeats")).alias("capped"), F.round("_d", 6).alias("distance"))


def _both(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/source_weights.parquet")


SQL: dict = {}
QUERIES = {"p8_mixture": lambda spark, d: mixture(*_both(spark, d)), "p8_shares": lambda spark, d: shares(*_both(spark, d))}
