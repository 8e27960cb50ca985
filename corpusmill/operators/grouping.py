"""Elements of pages and sentences of documents: ordered groups, paragraphs, blocks, valid sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.labels import VERB_TAGS

# Tags and relations without meaning at the start of a sentence, and those of formulas.
START_TAGS = ("SP", "_SP", "LS", "$(", "$,", "SYM", "X", "EOL", "SPACE", ":", "HYPH", "NIL", "ADD", "NFP", "XX", "$.", "ITJ")
START_DEPS = ("punct", "dep", "advmod", "intj", "list", "meta", "orphan")
FORMULA_TAGS = ("LS", "$(", "$,", "SYM", "X", ":", "HYPH")
FORMULA_DEPS = ("dep", "list", "meta", "orphan")
MOST_PERIODS, MOST_FORMULA = 3, 4


def grouped(elements: DataFrame, *keys: str, pos: str = "elem_pos", text: str = "text") -> DataFrame:
    """A1, A3: (keys, first_pos, n, block): elements of a group in input order; first_pos orders the groups
    as they were first met; block is their texts one after another (A4). Null texts count as empty."""
    items = F.sort_array(F.collect_list(F.struct(pos, text)))
    g = elements.groupBy(*keys).agg(items.alias("_i"), F.min(pos).alias("first_pos"), F.count("*").alias("n"))
    return g.select(*keys, "first_pos", "n", F.array_join(F.transform("_i", lambda x: F.coalesce(x[text], F.lit(""))), "").alias("block"))


def paragraphs(elements: DataFrame, *keys: str, pos: str = "elem_pos", text: str = "text") -> DataFrame:
    """A2: the elements with par_num, from 0 within `keys`: a paragraph closes after an element whose text,
    without outer white space, ends with . ! or ?. No empty last paragraph is made."""
    ends = F.coalesce(F.col(text).rlike(r"[.!?]\s*$").cast("int"), F.lit(0))
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return elements.withColumn("par_num", F.coalesce(F.sum(ends).over(w), F.lit(0)).cast("long"))


def blocks_until_length(elements: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "text", min_length: int = 5000) -> DataFrame:
    """A5: (key, block_no, block): texts of a key joined by line ends until longer than `min_length`; the rest
    makes the last block. A fold over the ordered array, inside the JVM. Null texts count as empty."""
    items = elements.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, F.coalesce(text, F.lit("")).alias("t")))).alias("_i"))
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(s["open"].isNull(), x["t"]).otherwise(F.concat(s["open"], F.lit("\n"), x["t"]))
        full = F.length(now) > min_length
        return F.struct(F.when(~full, now).alias("open"), F.when(full, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"))

    z = items.select(key, F.aggregate("_i", start, step).alias("s"))
    out = F.concat(F.col("s.done"), F.when(F.coalesce(F.col("s.open"), F.lit("")) != "", F.array("s.open")).otherwise(F.array().cast("array<string>")))
    return z.select(key, F.posexplode(out).alias("block_no", "block"))


def text_blocks(docs: DataFrame, most: int = 10000) -> DataFrame:
    """F1, first part: (doc_id, part, piece, block): texts divided at empty lines, then cut hard at `most`."""
    p = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("part", "t"))
    at = F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)), F.lit(most))
    return p.select("doc_id", "part", F.posexplode(F.transform(at, lambda s: F.substring(F.col("t"), s, F.lit(most)))).alias("piece", "block"))


def sentence_verdicts(tokens: DataFrame) -> DataFrame:
    """F1, cascade: (doc_id, sent_id, verdict): `formula` for more than 3 periods or 4 formula tokens, `no_verb`
    where the root isn't a verb (or there is none), `question`, `imperative` where the first meaningful
    token is a verb, else `valid`. Repeated tokens count once; a sentence is one array."""
    t = tokens.where("sent_id IS NOT NULL").dropDuplicates(["doc_id", "sent_id", "token_i"])
    a = t.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("token_i", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("dep", F.lit("")).alias("dep")))).alias("a"))
    periods = F.aggregate("a", F.lit(0), lambda s, x: s + F.length(F.regexp_replace(x["text"], "[^.]", "")))
    formula = F.size(F.filter("a", lambda x: x["tag"].isin(*FORMULA_TAGS) | x["dep"].isin(*FORMULA_DEPS)))
    roots = F.filter("a", lambda x: F.lower(x["dep"]) == "root")
    root = F.try_element_at(roots, F.lit(-1))["tag"]  # the last one counts
    first = F.try_element_at(F.filter("a", lambda x: ~(x["tag"].isin(*START_TAGS) | x["dep"].isin(*START_DEPS))), F.lit(1))["tag"]
    v = (
        F.when((periods > MOST_PERIODS) | (formula > MOST_FORMULA), "formula")
        .when(~F.coalesce(root.isin(*VERB_TAGS), F.lit(False)), "no_verb")
        .when(F.try_element_at("a", F.lit(-1))["text"] == "?", "question")
        .when(F.coalesce(first.isin(*VERB_TAGS), F.lit(False)), "imperative")
        .otherwise("valid")
    )
    return a.select("doc_id", "sent_id", v.alias("verdict"))


def valid_sentences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, text): valid sentences, tokens joined by spaces, line ends as spaces."""
    ok = sentence_verdicts(tokens).where("verdict = 'valid'")
    t = tokens.dropDuplicates(["doc_id", "sent_id", "token_i"]).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("token_i", "text"))).alias("a"))
    s = F.array_join(F.transform("a", lambda x: x["text"]), " ")
    return t.join(ok, ["doc_id", "sent_id"]).select("doc_id", "sent_id", F.trim(F.regexp_replace(s, "\n", " ")).alias("text"))


def joined_sentences(sentences: DataFrame) -> DataFrame:
    """(doc_id, text): sentences in order, a line each."""
    g = sentences.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_ind", "text"))).alias("a"))
    return g.select("doc_id", F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text"))
