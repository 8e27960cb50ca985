"""Functions on strings and arrays of strings, as Columns; Python only for Unicode normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition. Combining marks stay. Null for null."""
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKD", t), na_action="ignore")


def normalize_text_block(c: Column, decompose: bool = True) -> Column:
    """A block of extracted text as running text: hyphens, slashes and plus signs before a line end
    go with it, double quotes become spaces, lines that don't end a sentence join a lower-case next one,
    lines that do join a next one starting with A-Z or 0-9, newlines and spaces are collapsed."""
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    c = F.regexp_replace(c, r"[-–—−/+]\n", "")
    c = F.regexp_replace(c, "[\"“”]", " ")
    if decompose:
        c = nfkd(c)
    c = F.regexp_replace(c, r"([^.!? \n]) *\n+ *(?=[a-z])", "$1 ")
    c = F.regexp_replace(c, r"([.!?]) *\n+ *(?=[A-Z0-9])", "$1 ")
    c = F.regexp_replace(F.regexp_replace(c, r"\n+", "\n"), r" +", " ")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitize_sentence(c: Column) -> Column:
    """Everything but letters A to z (with the six signs between Z and a) and digits as one space, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[^a-zA-z0-9]", " ")), " +", " ")


def split_sentences(c: Column) -> Column:
    """Pieces up to and with their end marks (a rule, not a trained splitter)."""
    return F.regexp_extract_all(c, F.lit("[^.!?]+[.!?]*"), F.lit(0))


def normalize_term(c: Column) -> Column:
    """Runs of a-z letters, joined by one space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z]+", " ")))


def _plural_word(a: Column, b: Column) -> Column:
    def one(x, y):
        return (F.concat(x, F.lit("s")) == y) | (F.regexp_replace(x, "y$", "ies") == y) & x.endswith("y")

    return (a == b) | one(a, b) | one(b, a)


def singular_plural(a: Column, b: Column) -> Column:
    """Whether two terms are equal but for plural endings, word by word. Null if either is null."""
    x, y = F.split(a, " "), F.split(b, " ")
    by_word = (F.size(x) == F.size(y)) & (F.size(x) > 1) & F.forall(F.zip_with(x, y, _plural_word), lambda p: F.coalesce(p, F.lit(False)))
    return _plural_word(a, b) | by_word


def count_words(c: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def subterms(c: Column, least: int = 1) -> Column:
    """X11: all contiguous proper sub-sequences of a term's words, repeats kept; empty for terms of at most `least` words."""
    w = F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    n = F.size(w)
    spans = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.when(k < n, F.array_join(F.slice(w, i, k), " "))),
    )
    return F.when(n > least, F.filter(F.flatten(spans), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Lower-case runs of letters: the built-in tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def content_key(*c: Column) -> Column:
    """Key of a value's content. All inputs go into it."""
    return F.sha2(F.to_json(F.struct(*c)), 256)


def file_key(c: Column) -> Column:
    """A string as a file name."""
    return F.base64(F.encode(c, "UTF-8"))
