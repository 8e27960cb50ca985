"""Documents as a stream: candidate terms counted as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F




def documents(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def term_counts_by_window(docs: DataFrame, length: str = "1 day", late: str = "7 days", at: str = "ingested_at") -> DataFrame:
    """(window_start, term, cnt): candidates of documents by the time they were taken in; rows later than `late`
    behind the latest are dropped, and a window's state with them."""
    d = docs.withWatermark(at, late).select("doc_id", at, "text")
    c = d.select(at, F.explode(_terms()).alias("term"))
    return c.groupBy(F.window(at, length).alias("w"), "term").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), "term", "cnt")


def _terms():
    from corpusmill.functions.text import words
    from corpusmill.operators.terms import STOP_WORDS

    w = F.transform(words(F.col("text")), lambda t: F.when(t.isin(*STOP_WORDS), F.lit("|")).otherwise(t))
    return F.filter(F.transform(F.split(F.array_join(w, " "), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
