"""Tokens for texts without a parser: rules in place of a trained model.

A provider is any function from documents (doc_id, text) to tokens (doc_id, sent_id, token_i, text, lemma, pos,
tag, dep, head_i, is_punct); a model is loaded once a Python worker by `PerWorker`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import split_sentences
from corpusmill.operators.terms import STOP_WORDS


def rule_tokens(docs: DataFrame) -> DataFrame:
    """Tokens by rules: words and single marks; function words DET, numbers NUM, marks PUNCT, words in -ing VERB, other
    words NOUN. Not a part-of-speech tagger."""
    s = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("sent_id", "s"))
    t = s.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all(F.col("s"), F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), F.lit(0))).alias("p", "text"))
    low = F.lower("text")
    pos = F.when(~F.col("text").rlike(r"[\p{L}\p{N}]"), "PUNCT").when(F.col("text").rlike(r"^\p{N}"), "NUM").when(low.isin(*STOP_WORDS), "DET").when(low.endswith("ing") & (F.length(low) > 5), "VERB").otherwise("NOUN")
    t = t.withColumn("pos", pos).withColumn("token_i", (F.row_number().over(W.partitionBy("doc_id").orderBy("sent_id", "p")) - 1).cast("int"))
    tag = F.create_map(*[F.lit(x) for x in ("PUNCT", ".", "NUM", "CD", "DET", "DT", "VERB", "VBG", "NOUN", "NN")])[F.col("pos")]
    return t.select("doc_id", "sent_id", "token_i", "text", low.alias("lemma"), "pos", tag.alias("tag"), F.lit("dep").alias("dep"), F.lit(None).cast("int").alias("head_i"), (F.col("pos") == "PUNCT").alias("is_punct"))


class PerWorker:
    """A model built on first use in each worker, and again after every `reload_every` calls if given."""

    def __init__(self, load: Callable, reload_every: int | None = None):
        self.load, self.every, self.calls, self.model = load, reload_every, 0, None

    def __getstate__(self):
        return {"load": self.load, "every": self.every, "calls": 0, "model": None}

    def __call__(self):
        if self.model is None or self.every and self.calls % self.every == 0:
            self.model = self.load()
        self.calls += 1
        return self.model


def provided(docs: DataFrame, model: PerWorker, run: Callable, schema: str) -> DataFrame:
    """`run(model, batch)` over batches of `docs`, the model built once a worker."""

    def each(batches):
        for b in batches:
            yield run(model(), b)

    return docs.mapInPandas(each, schema)
