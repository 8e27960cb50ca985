"""Terms of documents: candidates, counts, and scores (ComboBasic, C-value, TF-IDF), synonyms.

Every operator keeps doc_id in its keys, so a corpus is scored in one plan and no document is treated
apart. Joins are on (doc_id, term), which spreads a frequent term over its documents; a join on the term alone
is salted for frequent ones.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.labels import word_category
from corpusmill.functions.text import count_words, subterms, words
from corpusmill.operators.graph import connected_components
from corpusmill.plans.lineage import written
from corpusmill.plans.skew import hot_keys, salted_join

#: Words that end a candidate where tokens have no tags (a short list of function words).
STOP_WORDS = (
    "the a an of in on at by to for from with and or but as is are was were be been it its this that these those their our his her they we you he she not no so than then which who what when where why how "
    "der die das des dem den ein eine einer eines und oder aber in im am an auf aus von zu zur zum mit ist sind wird nicht "
    "le la les un une des du de et ou mais dans sur par pour avec est sont pas que qui "
    "el los las una unos unas y o pero en por para con es son no que del al "
    "il lo gli i uno e ma nel nella di da con per è sono non che del della "
    "os as um uma e ou mas em no na por para com é são não que do da "
    "и в на с по для от из не что это но или"
).split()


def candidates(docs: DataFrame, least: int = 1, most: int = 4) -> DataFrame:
    """(doc_id, term): one row per occurrence of a run of `least` to `most` words without a stop word.

    Built-in candidates for texts without tags; no shuffle. Null and empty texts have none."""
    w = F.transform(words(F.col("text")), lambda t: F.when(t.isin(*STOP_WORDS), F.lit("|")).otherwise(t))
    runs = F.split(F.array_join(w, " "), r"\|")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.transform(runs, lambda x: F.trim(x))).alias("term")).where((F.col("term") != "") & count_words(F.col("term")).between(least, most))


def term_counts(occurrences: DataFrame) -> DataFrame:
    """(doc_id, term, cnt)."""
    return occurrences.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


def tagged_term_counts(occ: DataFrame, min_freq: int = 1) -> DataFrame:
    """A7 and F7 with lemmas: (doc_id, term, lemma, cnt, lemma_cnt) of occurrences (doc_id, pos, term, lemma).
    The lemma met last stands for the term; a term is kept if its lemma's count is at least `min_freq`."""
    t = occ.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"), F.max_by("lemma", "pos").alias("lemma"))
    lem = occ.groupBy("doc_id", "lemma").agg(F.count("*").alias("lemma_cnt"))
    return t.join(lem, ["doc_id", "lemma"]).where(F.col("lemma_cnt") >= min_freq).select("doc_id", "term", "lemma", "cnt", "lemma_cnt")


def only_listed(terms: DataFrame, listed: DataFrame) -> DataFrame:
    """terms of a list (`term`)."""
    return terms.join(listed.select("term").distinct(), "term", "left_semi").select(*terms.columns)


def ends_with_letter(terms: DataFrame) -> DataFrame:
    """terms whose last character is a letter of any script."""
    return terms.where(F.col("term").rlike(r"\p{L}$"))


def doc_frequency(counts: DataFrame) -> DataFrame:
    """(term, df) of (doc_id, term, ...), each document once."""
    return counts.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def corpus_counts(counts: DataFrame, min_freq: int = 2) -> DataFrame:
    """A10: (term, cnt) over all documents, from `min_freq` on."""
    return counts.groupBy("term").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= min_freq)


def _ranked(df: DataFrame, score: str) -> DataFrame:
    """Rank by score, equal scores by term, both descending. Scores are compared as rounded to 9 places."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.round(score, 9).desc(), F.desc("term"))).cast("long"))


# Weights of the scores.
COMBO_WEIGHTS = (1.0, 0.75, 0.1)
C_VALUE_WEIGHTS = (0.1, 1.0, 0.5)


def combo_basic(counts: DataFrame) -> DataFrame:
    """B2: (doc_id, term, cnt, contained_in, contains, score, rank). score is words * ln(cnt), 0.75 for
    each place where a longer candidate holds the term, 0.1 for each candidate it holds."""
    inner = counts.select("doc_id", F.col("term").alias("outer"), F.explode(subterms(F.col("term"))).alias("term"))
    pairs = inner.join(counts.select("doc_id", "term"), ["doc_id", "term"])
    # the join is made once; each pair counts for both of its ends
    ends = F.array(F.struct("term", F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("outer").alias("term"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sides = pairs.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.term", "e.i", "e.o")
    n = sides.groupBy("doc_id", "term").agg(F.sum("i").alias("contained_in"), F.sum("o").alias("contains"))
    z = counts.select("doc_id", "term", "cnt").join(n, ["doc_id", "term"], "left").na.fill(0, ["contained_in", "contains"])
    a, b, c = COMBO_WEIGHTS
    return _ranked(z.withColumn("score", a * count_words(F.col("term")) * F.ln("cnt") + b * F.col("contained_in") + c * F.col("contains")), "score")


def suffix_factors(counts: DataFrame) -> DataFrame:
    """(doc_id, term, cnt, suffix_count, suffix_factor). The suffix of a term is what follows its first
    space; suffix_count is the count of all longer terms it ends, at most its own, suffix_factor the
    largest of them over that sum, each at most that; 0 and 1 where there is none."""
    up = counts.where(F.col("term").contains(" ")).select("doc_id", F.expr("substring(term, instr(term, ' ') + 1)").alias("term"), "cnt")
    s = up.groupBy("doc_id", "term").agg(F.sum("cnt").alias("s"), F.max("cnt").alias("m"))
    z = counts.select("doc_id", "term", "cnt").join(s, ["doc_id", "term"], "left")
    sc = F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.least("s", "cnt"))
    return z.select("doc_id", "term", "cnt", sc.alias("suffix_count"), F.when(sc > 0, F.least("m", sc) / sc).otherwise(F.lit(1.0)).alias("suffix_factor"))


def c_value(counts: DataFrame, weights: tuple[float, float, float] = C_VALUE_WEIGHTS) -> DataFrame:
    """suffix_factors() with score, standalone count and rank."""
    a, b, g = weights
    if a <= 0:
        raise ValueError("the first weight must be above 0")
    s = suffix_factors(counts)
    score = F.ln(a + count_words(F.col("term"))) * (b * (F.col("cnt") - F.col("suffix_count")) + g * F.col("suffix_count") * (1 - F.col("suffix_factor")))
    return _ranked(s.withColumn("score", score).withColumn("standalone", F.col("cnt") - F.col("suffix_count")), "score")


def tf_idf(counts: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(doc_id, term, tf, df, tf_idf, rank): tf the share of the document's counts, idf ln(N / df), N all
    documents (by default those with counts). The number of documents joins as one row."""
    total = counts.groupBy("doc_id").agg(F.sum("cnt").alias("total"))
    n = counts.select("doc_id").distinct().agg(F.count("*").alias("n")) if n_docs is None else None
    df = written(doc_frequency(counts), "df")
    z = salted_join(counts.select("doc_id", "term", "cnt").join(total, "doc_id"), df, "term", hot_keys(df, "term", "df"))
    z = z.crossJoin(F.broadcast(n)) if n is not None else z.withColumn("n", F.lit(n_docs))
    z = z.select("doc_id", "term", (F.col("cnt") / F.col("total")).alias("tf"), "df", (F.col("cnt") / F.col("total") * F.ln(F.col("n") / F.col("df"))).alias("tf_idf"))
    return _ranked(z, "tf_idf")


def category_counts(tokens: DataFrame) -> DataFrame:
    """(word, categories): for each lower-case word its categories with counts, most frequent first."""
    c = tokens.where("text IS NOT NULL").groupBy(F.lower("text").alias("word"), word_category(F.col("tag")).alias("category")).count()
    return c.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "category"))), lambda x: F.struct(x["category"].alias("category"), (-x["n"]).alias("cnt"))).alias("categories"))


def word_lemmas(tokens: DataFrame) -> DataFrame:
    """(text, pos, lemma): the lemma met last of each word and part of speech."""
    return tokens.where("lemma IS NOT NULL").groupBy("text", "pos").agg(F.max_by("lemma", F.struct("doc_id", "token_i")).alias("lemma"))


# Classes of tokens as letters, and the four patterns of candidates over them; the last
# token of a match only bounds it.
TOKEN_PATTERNS = {
    "1": "[ANn]*G*M*H*[ANn]*G*[GV]*M*H*[ANn]*G*[GV]*N+[^ANn]",
    "1A": "[ANn]*G*[GV]*M*H*[ANn]*G*[GV]*M*H*[ANn]*G+[GV]*[^ANn]",
    "2": "N+P+[ANn]*N+[^ANn]",
    "3": "[ANn]*N+[ID]+[ANn]*N+[^ANnI]",
}


def token_class():
    """The class letter of a token (columns pos, tag, is_punct); a hyphen tag decides last."""
    p, t = F.col("pos"), F.col("tag")
    return (
        F.when(p == "ADJ", "A").when(p.isin("NOUN", "PROPN"), F.when(F.col("is_punct"), "n").otherwise("N")).when(p == "NUM", "M")
        .when((p == "VERB") & (t == "VBG"), "G").when(p == "VERB", "V").when(p == "PART", "P").when(p == "ADP", "I").when(p.isin("DET", "CCONJ"), "D").when(t == "HYPH", "H").otherwise("O")
    )


def pattern_candidates(tokens: DataFrame, least: int = 1, most: int = 4, lower_lemmas: bool = True) -> DataFrame:
    """(doc_id, pattern, pos, term, lemma), one row per match of each pattern by itself.

    Of the longest match at each start, matches are kept by length, then start, where they don't
    overlap. The bounding token is dropped; terms are lower case unless they hold a proper noun; of
    lemmas only letters (and the signs between Z and a) stay. A null lemma counts as the text.
    Sentences are matched in one piece per document, as patterns may run to its end; a document is the
    unit of work. Repeated tokens count once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("token_i").sort_values("token_i")
        code = "".join(pdf["cls"])
        text, lemma, pos = pdf["text"].tolist(), pdf["lemma"].tolist(), pdf["pos"].tolist()
        rows = []
        for name, pat in TOKEN_PATTERNS.items():
            rx = re.compile(pat)
            spans = [(m.end() - m.start(), m.start()) for i in range(len(code)) if (m := rx.match(code, i))]
            used = bytearray(len(code))
            for n, s in sorted(spans, key=lambda x: (-x[0], x[1])):
                if any(used[s : s + n]):
                    continue
                used[s : s + n] = b"\1" * n
                e = s + n - 1
                proper = "PROPN" in pos[s:e]
                t = " ".join(text[s:e]).strip()
                lem = " ".join(lemma[i] if pos[i] == "PROPN" and not lower_lemmas else lemma[i].lower() for i in range(s, e))
                lem = re.sub(" +", " ", re.sub("[^a-zA-z]", " ", lem)).strip()
                rows.append((name, s, t if proper else t.lower(), lem))
        out = pd.DataFrame(rows, columns=["pattern", "pos", "term", "lemma"])
        out.insert(0, "doc_id", pdf["doc_id"].iat[0])
        return out

    t = tokens.where("doc_id IS NOT NULL AND token_i IS NOT NULL AND text IS NOT NULL").select("doc_id", "token_i", "text", F.coalesce("lemma", "text").alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos"), token_class().alias("cls"))
    m = t.groupBy("doc_id").applyInPandas(run, "doc_id long, pattern string, pos long, term string, lemma string")
    return ends_with_letter(m).where(count_words(F.col("term")).between(least, most))


def synonyms_by_lemma(counts: DataFrame) -> DataFrame:
    """(lemma, syn, rep): in each group of one lemma the term of the highest count stands for the
    others; at equal counts the first in order. `counts` has term, lemma, cnt."""
    w = W.partitionBy("lemma").orderBy(F.desc("cnt"), "term")
    best = counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("lemma", F.col("term").alias("rep"))
    return counts.join(best, "lemma").where("term <> rep").select("lemma", F.col("term").alias("syn"), "rep")


def without_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """terms that aren't represented by another."""
    return terms.join(synonyms.select(F.col("syn").alias("term")), "term", "left_anti").select(*terms.columns)


def merged_synonyms(first: DataFrame, second: DataFrame) -> DataFrame:
    """(syn, rep) of two stages as one map. A representative that the second stage replaces passes
    its synonyms on: groups are connected components, represented by the representative of the last stage."""
    both = first.select("syn", "rep", F.lit(1).alias("stage")).union(second.select("syn", "rep", F.lit(2).alias("stage")))
    comp = connected_components(both, "syn", "rep")
    reps = both.select("rep", "stage").distinct().join(both.select(F.col("syn").alias("rep")), "rep", "left_anti")
    last = reps.join(comp.withColumnRenamed("node", "rep"), "rep").groupBy("component").agg(F.max_by("rep", F.struct("stage", "rep")).alias("rep"))
    return comp.join(last, "component").where("node <> rep").select(F.col("node").alias("syn"), "rep")


def representatives_to_synonyms(synonyms: DataFrame) -> DataFrame:
    """(rep, syns)."""
    return synonyms.groupBy("rep").agg(F.sort_array(F.collect_set("syn")).alias("syns"))


def disjoint_terms(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, score, total): per key the best-scored term, then the best that shares no word with
    those taken, and so on. Equal scores: the later in order first. Terms without words are left out.
    A fold over the key's terms in order of score, inside the JVM."""
    w = F.regexp_extract_all(F.col("term"), F.lit(r"\S+"), F.lit(0))
    t = terms.where(F.size(w) > 0).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("score", "term", w.alias("w"))), asc=False).alias("a"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<score:double,term:string>>").alias("kept"))
    fold = F.aggregate(
        F.col("a"), start,
        lambda s, x: F.when(F.arrays_overlap(s["used"], x["w"]), s).otherwise(
            F.struct(F.concat(s["used"], x["w"]).alias("used"), F.concat(s["kept"], F.array(F.struct(x["score"].cast("double").alias("score"), x["term"].alias("term")))).alias("kept"))))
    z = t.select(key, fold["kept"].alias("kept"))
    total = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["score"])
    return z.select(key, total.alias("total"), F.explode("kept").alias("k")).select(key, "k.term", "k.score", "total")


def synonym_partitions(synonyms: DataFrame, scores: DataFrame, one_pass: bool = False) -> DataFrame:
    """U4: (term, rep): groups of synonyms, each represented by its best-scored member (ties: the later
    term). Groups are connected components; with `one_pass`, terms are taken in order and join the first
    group they or their synonyms meet, which may leave groups unmerged; a component is a unit of work, as
    terms of different ones never meet."""
    comp = connected_components(synonyms, "term", "synonym")
    if one_pass:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            near = defaultdict(set)
            for a, b in zip(pdf["term"], pdf["synonym"]):
                near[a].add(b)
                near[b].add(a)
            at: dict[str, str] = {}
            for t in sorted(near):
                if t in at:
                    continue
                group, todo = {t}, sorted(near[t])
                for x in todo:
                    if x not in at:
                        group.add(x)
                for x in group:
                    at[x] = t
            return pd.DataFrame({"node": list(at), "component": list(at.values())})

        each = synonyms.select("term", "synonym").join(comp.withColumnRenamed("node", "term"), "term")
        comp = each.groupBy("component").applyInPandas(lambda p: run(p), "node string, component string")
    s = comp.join(scores.select(F.col("term").alias("node"), "score"), "node", "left")
    best = s.groupBy("component").agg(F.max_by("node", F.struct("score", "node")).alias("rep"))
    return s.join(best, "component").select(F.col("node").alias("term"), "rep")


def fewer_contexts(pairs: DataFrame, contexts: DataFrame, size: DataFrame) -> DataFrame:
    """(t1, t2, other, context_term): the context terms of the term of each pair that has fewer, and the other term."""
    p = pairs.join(size.select(F.col("term").alias("t1"), F.col("n").alias("n1")), "t1").join(size.select(F.col("term").alias("t2"), F.col("n").alias("n2")), "t2")
    first = F.col("n1") <= F.col("n2")
    p = p.select("t1", "t2", F.when(first, F.col("t1")).otherwise(F.col("t2")).alias("term"), F.when(first, F.col("t2")).otherwise(F.col("t1")).alias("other"))
    return p.join(contexts, "term").select("t1", "t2", "other", "context_term")


def jaccard_distance(contexts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t1, t2, distance): 1 less the shared part of two terms' context terms; 1 where either has none.

    The context terms of the term of a pair that has fewer are looked up among those of the other by an equi-join,
    and the size of each term's own is an aggregate, so no term's contexts are ever gathered in one row."""
    c = contexts.where("term IS NOT NULL AND context_term IS NOT NULL").select("term", "context_term").distinct()
    size = written(c.groupBy("term").agg(F.count("*").alias("n")), "sizes")
    asked = pairs.select("t1", "t2")
    both = fewer_contexts(asked.distinct(), c, size).join(c.withColumnRenamed("term", "other"), ["other", "context_term"]).groupBy("t1", "t2").agg(F.count("*").alias("both"))
    j = asked.join(size.select(F.col("term").alias("t1"), F.col("n").alias("n1")), "t1", "left").join(size.select(F.col("term").alias("t2"), F.col("n").alias("n2")), "t2", "left").join(both, ["t1", "t2"], "left")
    shared = F.coalesce("both", F.lit(0))
    return j.select("t1", "t2", F.coalesce(1 - shared / (F.col("n1") + F.col("n2") - shared), F.lit(1.0)).alias("distance"))


def sentence_matches(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, sent_ind): sentences that contain a term anywhere, case aside, each once.

    A term meets the sentences that hold its rarest run of three letters (itself, if it is shorter): of the runs
    of all sentences only those of some term are kept, as ids; the fewest per term are joined on, then the
    texts of these sentences alone are fetched and `contains` decides. Equi-joins throughout."""
    low = sentences.where("text IS NOT NULL AND doc_id IS NOT NULL AND sent_ind IS NOT NULL").select("doc_id", "sent_ind", F.lower("text").alias("s"))
    t = terms.where("term IS NOT NULL AND term <> ''").select("term", F.lower("term").alias("t")).distinct()
    n = F.length("t")
    runs = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(k))))
    own = written(t.withColumn("g", F.explode(F.when(n >= 3, runs("t", 3)).otherwise(F.array("t")))), "runs")
    wanted = own.select("g").distinct()
    grams = low.select("doc_id", "sent_ind", F.explode(runs("s", 3)).alias("g"))
    for k in (1, 2):
        grams = grams.union(low.select("doc_id", "sent_ind", F.explode(runs("s", k)).alias("g"))) if not own.where(n == k).isEmpty() else grams
    grams = written(grams.join(wanted, "g", "left_semi").distinct(), "grams")
    held = grams.groupBy("g").agg(F.count("*").alias("n"))
    best = own.join(held, "g").groupBy("term", "t").agg(F.min(F.struct("n", "g")).alias("m")).select("term", "t", F.col("m.g").alias("g"))
    found = grams.join(best, "g").select("term", "t", "doc_id", "sent_ind")
    return found.join(low, ["doc_id", "sent_ind"]).where(F.contains("s", "t")).select("term", "doc_id", "sent_ind").distinct()


def context_band(matches: DataFrame, lengths: DataFrame, window: int) -> DataFrame:
    """(term, doc_id, sent_ind): for each matched sentence those up to `window` away, within the document
    (`lengths`: doc_id, n), repeats kept where windows overlap."""
    j = matches.join(lengths, "doc_id")
    return j.select("term", "doc_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("sent_ind") - window), F.least(F.col("n") - 1, F.col("sent_ind") + window))).alias("sent_ind"))


def with_representative(items: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Items (..., term) with the term_ind of the term, lower-cased, or of its representative; items
    of neither are left out."""
    i = items.withColumn("_t", F.lower("term"))
    own = terms.select(F.col("term").alias("_t"), F.col("term_ind").alias("_a"))
    rep = synonyms.select(F.col("syn").alias("_t"), "rep").join(terms.select(F.col("term").alias("rep"), F.col("term_ind").alias("_b")), "rep").select("_t", "_b")
    return i.join(own, "_t", "left").join(rep, "_t", "left").withColumn("term_ind", F.coalesce("_a", "_b")).where("term_ind IS NOT NULL").drop("_t", "_a", "_b")
