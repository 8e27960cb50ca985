"""Reading book folders, page text, wiki dumps, treebanks and line corpora."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def book_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name): the regular files of a folder, not of folders in it, in order. Contents aren't read."""
    p = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return p.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).orderBy("name")


def pdftotext(content: bytes) -> str:
    """Text of a PDF by the program pdftotext, where it is installed."""
    return subprocess.run(["pdftotext", "-enc", "UTF-8", "-", "-"], input=content, capture_output=True, check=True).stdout.decode("utf-8", "replace")


def book_texts(spark: SparkSession, folder: str, extract: Callable[[bytes], str] = pdftotext, pattern: str = "*.pdf", cache: str | None = None) -> DataFrame:
    """(path, text) of the files of a folder: `extract` on their bytes, form feeds as spaces, NFKD. With
    `cache`, texts found there are read and the others added (K1); files already done aren't opened."""
    from corpusmill.functions.text import nfkd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    done = _table_or_none(spark, cache)
    if done is not None:
        files = files.join(done.select("path"), "path", "left_anti")

    def run(it):
        for p in it:
            yield pd.DataFrame({"path": p["path"], "text": [extract(bytes(c)) for c in p["content"]]})

    new = files.select("path", "content").mapInPandas(run, "path string, text string")
    new = new.select("path", nfkd(F.regexp_replace("text", "\f", " ")).alias("text"))
    if cache is None:
        return new
    new.write.mode("append").parquet(cache)
    return spark.read.parquet(cache)


def _table_or_none(spark: SparkSession, path: str | None) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    if path is None:
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def wiki_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(page_id, ns, title, text) of a dump, packed or not. A malformed page stops the read. A packed
    dump may be one partition: give `partitions` to spread it before its pages are worked on."""
    schema = "title string, ns string, id long, revision struct<text:string>"
    p = spark.read.format("xml").option("rowTag", "page").option("mode", "FAILFAST").schema(schema).load(path)
    p = p.select(F.col("id").alias("page_id"), "ns", "title", F.col("revision.text").alias("text"))
    return p.repartition(partitions, "page_id") if partitions else p


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, word, word_id, pos, deprel, sentence) of CoNLL-U files: rows whose first column is a whole
    number, with the text named before them. A file is one row until its lines are taken apart."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("sentence", F.last(F.when(F.col("line").startswith("# text = "), F.expr("substring(line, 10)")), True).over(w))
    c = F.split("line", "\t")
    g = f.where(F.col("line").rlike(r"^\d+\t"))
    return g.select("file", "line_no", c[1].alias("word"), c[0].cast("int").alias("word_id"), F.get(c, F.lit(4)).alias("pos"), F.get(c, F.lit(7)).alias("deprel"), "sentence")


def some_sentence(bank: DataFrame, deprel: str, seed: int = 0) -> DataFrame:
    """One row of a relation, the same for the same seed."""
    return bank.where(F.col("deprel") == deprel).orderBy(F.xxhash64(F.lit(seed), "file", "line_no")).limit(1)


def line_corpus(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", tokens: bool = True) -> DataFrame:
    """(tag, text, tokens): a document a line, tags from 0 in the file's order."""
    from corpusmill.operators.wiki import tokens as split

    b = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("t"))
    z = b.select(F.posexplode(F.split(F.regexp_replace("t", r"\r?\n$", ""), r"\r?\n")).alias("tag", "text"))
    return z.withColumn("tokens", split(F.col("text"))) if tokens else z
