import math

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import grouping, terms

COUNTS = [(1, "red blue dog", 2), (1, "yellow blue dog", 1), (1, "blue dog", 3), (1, "his dog", 1), (1, "dog", 5)]


def counts(spark, rows=COUNTS):
    return spark.createDataFrame(rows, "doc_id long, term string, cnt long")


def test_combo_basic(spark):
    got = {r.term: (r.contained_in, r.contains, round(r.score, 6), r["rank"]) for r in terms.combo_basic(counts(spark)).collect()}
    assert got["red blue dog"][:3] == (0, 2, 2.279442)
    assert got["yellow blue dog"][:3] == (0, 2, 0.2)
    assert got["blue dog"][:3] == (2, 1, 3.797225)
    assert got["dog"][:3] == (4, 0, 4.609438)
    assert sorted(got, key=lambda t: got[t][3]) == ["dog", "blue dog", "red blue dog", "yellow blue dog", "his dog"]


def test_c_value(spark):
    got = {r.term: (r.suffix_count, round(r.suffix_factor, 6), round(r.score, 6)) for r in terms.c_value(counts(spark)).collect()}
    assert got == {"red blue dog": (0, 1.0, 2.262804), "yellow blue dog": (0, 1.0, 1.131402), "blue dog": (3, 0.666667, 0.370969), "his dog": (0, 1.0, 0.741937), "dog": (4, 0.75, 0.142965)}


def test_suffix_count_is_clamped(spark):
    got = {r.term: r.suffix_count for r in terms.suffix_factors(counts(spark, [(1, "fault", 1), (1, "'s fault", 1), (1, "Mike's fault", 1)])).collect()}
    assert got["fault"] == 1


def test_tf_idf(spark):
    got = {(r.doc_id, r.term): round(r.tf_idf, 6) for r in terms.tf_idf(counts(spark, [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 3)])).collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 0.231049, (2, "a"): 0.0, (2, "c"): 0.51986}


def test_empty_tables(spark):
    e = counts(spark, [])
    assert [f(e).count() for f in (terms.combo_basic, terms.c_value, terms.tf_idf, terms.doc_frequency)] == [0, 0, 0, 0]


def test_candidates_of_null_and_empty_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "The Red dog and the cat"), (None, "dog")], "doc_id long, text string")
    assert {tuple(r) for r in terms.candidates(d).collect()} == {(3, "red dog"), (3, "cat")}


def test_pattern_candidates(spark):
    rows = [(1, i, w, w.lower(), p, t) for i, (w, p, t) in enumerate([("The", "DET", "DT"), ("old", "ADJ", "JJ"), ("Rome", "PROPN", "NNP"), ("then", "ADV", "RB"), ("state", "NOUN", "NN"), ("of", "ADP", "IN"), ("art", "NOUN", "NN"), (".", "PUNCT", ".")])]
    t = spark.createDataFrame(rows, "doc_id long, token_i int, text string, lemma string, pos string, tag string").withColumn("is_punct", F.col("pos") == "PUNCT")
    got = {(r.pattern, r.term) for r in terms.pattern_candidates(t.union(t)).collect()}
    assert got == {("1", "old Rome"), ("1", "state"), ("1", "art"), ("3", "state of art")}


def test_disjoint_terms(spark):
    t = spark.createDataFrame([(1, "a b", 5.0), (1, "b c", 4.0), (1, "c d", 3.0), (1, " ", 9.0)], "doc_id long, term string, score double")
    got = terms.disjoint_terms(t).collect()
    assert {(r.term, r.total) for r in got} == {("a b", 8.0), ("c d", 8.0)}


def test_synonyms(spark):
    c = spark.createDataFrame([("dogs", "dog", 3), ("dog", "dog", 5), ("cat", "cat", 1)], "term string, lemma string, cnt long")
    assert [tuple(r) for r in terms.synonyms_by_lemma(c).collect()] == [("dog", "dogs", "dog")]
    a, b = (spark.createDataFrame([x], "syn string, rep string") for x in (("dogs", "dog"), ("dog", "hound")))
    assert {tuple(r) for r in terms.merged_synonyms(a, b).collect()} == {("dogs", "hound"), ("dog", "hound")}
    s = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "term string, synonym string")
    p = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("x", 1.0), ("y", 1.0)], "term string, score double")
    assert dict((r.term, r.rep) for r in terms.synonym_partitions(s, p).collect()) == {"a": "b", "b": "b", "c": "b", "x": "y", "y": "y"}
    assert terms.synonym_partitions(s, p, one_pass=True).count() == 5


def test_jaccard(spark):
    c = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", None)], "term string, context_term string")
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "t1 string, t2 string")
    assert {(r.t1, r.t2): r.distance for r in terms.jaccard_distance(c, p).collect()} == {("a", "b"): 0.5, ("a", "c"): 1.0, ("c", "d"): 1.0}


def test_text_functions(spark):
    d = spark.createDataFrame([("  the 'multi-\nword' text\nGoes on. \nNext\n\n\nline",), (None,)], "t string")
    got = [r[0] for r in d.select(T.normalize_text_block(F.col("t"))).collect()]
    assert got == ["the 'multiword' text\nGoes on. Next line", None]
    n = spark.createDataFrame([("Naïve",)], "t string").select(F.length(T.nfkd(F.col("t")))).first()[0]
    assert n == 6
    pairs = [("dog", "dogs", True), ("city", "cities", True), ("big dog", "big dogs", True), ("dog", "cat", False), ("a b", "a", False)]
    p = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in p.select(T.singular_plural(F.col("a"), F.col("b")), "w").collect())
    assert spark.createDataFrame([("a b c",)], "t string").select(T.subterms(F.col("t"))).first()[0] == ["a", "a b", "b", "b c", "c"]
    assert spark.createDataFrame([("a",)], "t string").select(T.subterms(F.col("t"))).first()[0] == []


def test_blocks_until_length(spark):
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate(["aaa", "bb", "cccc", "d"])], "doc_id long, pos int, text string")
    assert [r.block for r in grouping.blocks_until_length(e, min_length=4).orderBy("block_no").collect()] == ["aaa\nbb", "cccc\nd"]


def test_paragraphs(spark):
    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b. "), (1, 2, "c"), (1, 3, None)], "doc_id long, elem_pos int, text string")
    assert [r.par_num for r in grouping.paragraphs(e, "doc_id").orderBy("elem_pos").collect()] == [0, 0, 1, 1]


def test_sentence_matches_finds_short_and_long_terms(spark):
    s = spark.createDataFrame([(1, 0, "The Catalogue of it"), (1, 1, "nothing"), (2, 0, None)], "doc_id long, sent_ind int, text string")
    t = spark.createDataFrame([("catalog",), ("it",), ("",), (None,)], "term string")
    assert {tuple(r) for r in terms.sentence_matches(s, t).collect()} == {("catalog", 1, 0), ("it", 1, 0)}


def test_log_is_natural():
    assert math.isclose(math.log(math.e), 1)


def test_contexts_of_a_common_term_are_not_repeated_for_each_pair(spark):
    c = spark.createDataFrame([("a", str(i)) for i in range(500)] + [(f"r{k}", str(k)) for k in range(20)], "term string, context_term string")
    pairs = spark.createDataFrame([("a", f"r{k}") for k in range(20)] + [("r1", "r2")], "t1 string, t2 string")
    assert terms.fewer_contexts(pairs, c, c.groupBy("term").agg(F.count("*").alias("n"))).count() == 21
    got = {(r.t1, r.t2): r.distance for r in terms.jaccard_distance(c, pairs).collect()}
    assert got == {("a", f"r{k}"): 1 - 1 / 500 for k in range(20)} | {("r1", "r2"): 1.0}
