import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph, segments, sentence_graph, vectors, wiki, windows
from corpusmill.plans import catalogue
from corpusmill.plans.lineage import written
from corpusmill.plans.skew import hot_keys, salted_join
from corpusmill.sources import files, sinks
from tests.compare import FOLDER


def test_connected_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges if None not in e for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {n: root(n) for n in up}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), ("none", 2)], "k string, v int")
    small = spark.createDataFrame([("hot", 10), ("cold", 20)], "k string, w int")
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 0.5)
    assert hot == ["hot"]
    assert salted_join(big, small, "k", hot).groupBy("k").agg(F.sum("w")).orderBy("k").collect() == [("cold", 20), ("hot", 5000)]
    assert salted_join(big, small, "k", hot, how="left").count() == 502
    assert hot_keys(big.limit(0).groupBy("k").agg(F.count("*").alias("n")), "k", "n") == []


def test_topic_distance(spark):
    v = [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 3
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "doc_id long, sent_ind int, embedding array<double>")
    assert [r.distance for r in windows.topic_distance(df, 2, 2).orderBy("sent_ind").collect()] == [0.5, 0.25, 0.25, 0.5, 0.25, 0.25]


def test_change_counts_equal_window_by_window(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)] + [(2, i, r.tolist()) for i, r in enumerate(x[:6])], "doc_id long, sent_ind int, embedding array<double>")
    got = {(r.doc_id, r.sent_ind): r.cnt for r in windows.change_counts(df).collect()}
    want = {k: 0 for k in got}
    for w in range(3, 8):
        d = windows.topic_distance(df.where("doc_id = 1"), w, 3).select("doc_id", F.col("sent_ind").cast("long").alias("pos"), F.round("distance", 12).alias("value"))
        for r in windows.useful_extrema(d, w).collect():
            want[1, r.pos] += 1
    assert got == want and got[2, 3] == 0


def test_segment_tree_tiles_its_parents(spark):
    random.seed(3)
    rows = [(d, i, random.randint(0, 4)) for d in range(60) for i in range(random.randint(1, 40))]
    tree = segments.segment_tree(spark.createDataFrame(rows, "doc_id long, sent_ind int, cnt int")).collect()
    by = {}
    for r in tree:
        by.setdefault(r.doc_id, {})[r.node_id] = r
    for d, nodes in by.items():
        n = sum(1 for x in rows if x[0] == d)
        assert (nodes[1].start_at, nodes[1].end_at, nodes[1].parent_node_id) == (0, n - 1, 0)
        order = sorted(nodes.values(), key=lambda r: (r.start_at, r.level))
        assert [r.node_id for r in order] == list(range(1, len(nodes) + 1))
        for r in nodes.values():
            kids = sorted((k for k in nodes.values() if k.parent_node_id == r.node_id), key=lambda k: k.start_at)
            assert len(kids) in (0, 2)
            if kids:
                assert (kids[0].start_at, kids[0].end_at + 1, kids[1].end_at) == (r.start_at, kids[1].start_at, r.end_at)


def test_rollups_add_up(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 0, "1", 0, 3), (1, 2, 1, 1, "1-2", 0, 1), (1, 3, 1, 1, "1-3", 2, 3)], "doc_id long, node_id long, parent_node_id long, level int, path string, start_at long, end_at long")
    places = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "doc_id long, sent_ind long, term string")
    leaf = segments.leaf_term_counts(nodes, places)
    got = {(r.node_id, r.term): r.cnt for r in segments.rolled_up(leaf, segments.closure(nodes)).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 1, (2, "a"): 2, (3, "a"): 1, (3, "b"): 1}
    assert {tuple(r) for r in segments.closure(nodes).collect()} == {tuple(r) for r in segments.span_closure(nodes).select("doc_id", "node_id", "ancestor").collect()}
    v = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for i in range(4)], "doc_id long, sent_ind long, embedding array<double>")
    m = segments.node_means(nodes, v, 2)
    alt = {r.node_id: [round(x, 6) for x in r.alt_mean] for r in segments.alternative_means(nodes, m, 2).collect()}
    assert alt == {1: [0.707107, 0.707107], 2: [1.0, 0.0], 3: [0.0, 1.0]}


WIKI = "Intro ''text'' {{box|a={{b}}}} of [[Target|shown]] and [[Plain]].\n[[File:x.png|thumb|A [[cap]] tion]]\n==A==\n==B==\n text <ref name=x>gone</ref> more [http://a.b label]\n===C===\nend {{open"


def test_wiki_markup():
    t = wiki.plain(WIKI)
    assert "shown" in t and "Plain" in t and "cap tion" in t and "gone" not in t and "box" not in t and "label" in t and "open" not in t and "[" not in t
    assert wiki.plain(None) is None and wiki.plain("") == ""


def test_wiki_sections_and_links(spark):
    p = spark.createDataFrame([(1, "0", "T", "x\n==A==\n==B==\n text\n===C===\nz"), (2, "0", "U", None)], "page_id long, ns string, title string, text string")
    assert [(r.start, r.heading) for r in wiki.sections(p, adjacent=False).orderBy("section_no").collect()] == [(0, "BEGINNING"), (1, "A"), (19, "C")]
    s = wiki.sections(p).orderBy("section_no").collect()
    assert [r.heading for r in s] == ["BEGINNING", "A", "B", "C"]
    assert "".join(r.body for r in s) == "x\n==A==\n==B==\n text\n===C===\nz"
    q = spark.createDataFrame([(1, "0", "T", "#REDIRECT [[U]] [[Category:Z]]"), (2, "0", "U", "[[V|v]] [[V|w]]"), (3, "4", "N", "[[V]]")], "page_id long, ns string, title string, text string")
    g = {k: {tuple(r) for r in v.collect()} for k, v in wiki.link_graph(q).items()}
    assert g == {"titles": {("T",), ("U",)}, "redirects": {("T", "U")}, "link_counts": {("U", 1), ("V", 2)}, "text_counts": {("U", "U", 1), ("v", "V", 1), ("w", "V", 1)}, "categories": {("T", "Z")}}


TOKENS = [("The", "DT", "det", 1), ("man", "NN", "nsubj", 5), ("who", "WP", "nsubj", 3), ("sleeps", "VBZ", "acl:relcl", 1), ("is", "VBZ", "cop", 5), ("tired", "JJ", "ROOT", None), (".", ".", "punct", 5)]


def words(spark):
    t = spark.createDataFrame([(1, 0, i, w, w.lower(), g, d, h) for i, (w, g, d, h) in enumerate(TOKENS)], "doc_id long, sent_id int, token_i int, text string, lemma string, tag string, dep string, head_i int")
    return t, sentence_graph.words_of(t.union(t))


def test_sentence_graph(spark):
    t, w = words(spark)
    got = {(r.version, r.target) for r in sentence_graph.relative_resolutions(w).collect()}
    assert got == {("WH-res v1", 2), ("WH-res v2", 2), ("WH-res v3", 2)}
    assert sentence_graph.dependency_edges(w).count() == 6 and sentence_graph.word_order_edges(w).count() == 6
    r = {x.text: (x.head_id, x.dep) for x in sentence_graph.retokenized(t).collect()}
    by = {x.text: x.word_id for x in sentence_graph.retokenized(t).collect()}
    assert r["tired"] == (by["sleeps is"], "cop") or r["tired"][1] == "cop"
    n, e = sentence_graph.sentence_graph(w)
    assert sentence_graph.dot_text(n, e).first().dot.startswith("digraph {")
    m = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 5)], "doc_id long, cluster_id int, mention_pos int, first_i int")
    assert {(x.token_i, x.target_i) for x in sentence_graph.resolved_references(w, m).collect()} == {(2, 1), (5, 1)}


def test_constituency_tree(spark):
    nodes = [(1, 0, None, 0, "ROOT", None), (1, 1, 0, 0, "S", None), (1, 2, 1, 0, "NP", None), (1, 3, 2, 0, "NN", 1), (1, 4, 1, 1, "VP", None), (1, 5, 4, 0, "VBZ", 2), (1, 6, 1, 2, ".", 3)]
    tree = written(sentence_graph.numbered_tree(spark.createDataFrame([(7, *n) for n in nodes], "doc_id long, sent_id int, node int, parent int, child_pos int, label string, word_id int")), "tree")
    rows = [(1, 1, 2, "Man", "man", "NN", "nsubj"), (1, 2, 0, "runs", "run", "VBZ", "ROOT"), (1, 3, 2, ".", ".", ".", "punct")]
    w = spark.createDataFrame([(7, *r) for r in rows], "doc_id long, sent_id int, word_id long, head_id long, text string, lemma string, tag string, dep string")
    assert {r.text for r in sentence_graph.tree_text(tree, w).collect()} == {"Man runs .", "Man", "runs", "."}
    u = sentence_graph.unresolved_heads(tree, w)
    assert u.where("head_id = 0").count() == 4
    assert sentence_graph.highest_nodes(u).where("head_id = 2 AND dep = 'nsubj'").first().uid.endswith("000002")
    assert {r.role for r in sentence_graph.node_roles(tree, w).collect()} == {"subject", "main_verb"}
    assert sentence_graph.invalid_trees(tree).count() == 0
    assert sentence_graph.without_punctuation(tree, w).count() == 6
    assert {r.text for r in sentence_graph.tree_text(sentence_graph.without_punctuation(tree, w), w).collect()} == {"Man runs", "Man", "runs"}
    assert "runs (VBZ/ROOT)\nrun" in {r.node_label for r in sentence_graph.word_nodes(tree, w).collect()}


def test_words_of_nodes_are_not_broadcast(spark):
    """A table of words may be small on disk and large in the driver's memory; trees of many sentences lie in one batch."""
    kind = "doc_id long, sent_id int, node int, parent int, child_pos int, label string, word_id int"
    nodes = [(d, s, *n) for d in range(30) for s in range(5) for n in ((2, 0, 1, "NN", 2), (0, None, 0, "S", None), (1, 0, 0, "JJ", 1))]
    tree = written(sentence_graph.numbered_tree(spark.createDataFrame(nodes, kind)), "tree")
    assert sorted(tuple(r) for r in tree.select("doc_id", "sent_id", "uid", "word_id", "size").collect()) == sorted((d, s, f"{s}-{n:06d}", w, z) for d in range(30) for s in range(5) for n, w, z in ((0, None, 3), (1, 1, 1), (2, 2, 1)))
    words = sentence_graph.covered_words(tree)
    assert words.count() == 30 * 5 * 4
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    w = written(tree.where("word_id IS NOT NULL").select("doc_id", "sent_id", "word_id", F.lit(0).cast("long").alias("head_id"), F.lit("x").alias("dep")), "words")
    heads = sentence_graph.unresolved_heads(tree, w)
    assert "Broadcast" not in heads._jdf.queryExecution().executedPlan().toString() and heads.count() == 30 * 5 * 3


def test_trees_of_several_documents(spark):
    """Sentences are numbered within their document: words and trees of documents don't mix."""
    kind = "doc_id long, sent_id int, word_id long, head_id long, text string, lemma string, tag string, dep string"
    w = spark.createDataFrame([(1, 1, 1, 0, "red", "red", "JJ", "ROOT"), (2, 1, 1, 0, "blue", "blue", "NN", "ROOT"), (2, 1, 2, 1, ".", ".", ".", "punct")], kind)
    nodes = [(d, 1, 0, None, 0, "S", None) for d in (1, 2)] + [(d, 1, 1, 0, 0, t, 1) for d, t in ((1, "JJ"), (2, "NN"))] + [(2, 1, 2, 0, 1, ".", 2)]
    tree = written(sentence_graph.numbered_tree(spark.createDataFrame(nodes, "doc_id long, sent_id int, node int, parent int, child_pos int, label string, word_id int")), "tree")
    got = {(r.doc_id, r.uid): r.text for r in sentence_graph.tree_text(tree, w).collect()}
    assert got == {(1, "1-000000"): "red", (1, "1-000001"): "red", (2, "1-000000"): "blue .", (2, "1-000001"): "blue", (2, "1-000002"): "."}
    assert {(r.doc_id, r.role) for r in sentence_graph.node_roles(tree, w).collect()} == {(1, "main_adjective"), (2, "main_noun")}
    assert sentence_graph.tree_edges(tree).count() == 3 and sentence_graph.invalid_trees(tree).count() == 0
    assert sentence_graph.without_punctuation(tree, w).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 2), (2, 2)]
    n, e = sentence_graph.sentence_graph(w.withColumn("token_i", F.col("word_id").cast("int")), tree)
    assert e.where("extra = 'constituency'").count() == 3 and e.where("extra = 'dependency'").count() == 1


def sentence(rows):
    return {i + 1: {"head": h, "token_i": i, "text": t, "lemma": t, "tag": g, "dep": d} for i, (t, g, d, h) in enumerate(rows)}


def test_copulas_and_adverbs():
    w = sentence([("He", "PRP", "nsubj", 3), ("is", "VBZ", "cop", 3), ("tired", "JJ", "ROOT", 0), ("very", "RB", "advmod", 3)])
    sentence_graph._copulas(w)
    assert [(x["head"], x["dep"]) for x in w.values()] == [(2, "nsubj"), (0, "ROOT"), (2, "cop"), (3, "advmod")]
    w = sentence([("he", "PRP", "nsubj", 3), ("was", "VBD", "cop", 3), ("what", "WP", "nsubj", 6), ("is", "VBZ", "cop", 6), ("so", "RB", "advmod", 6), ("good", "JJ", "ROOT", 0)])
    sentence_graph._copulas(w)
    assert [(x["head"], x["dep"]) for x in w.values()] == [(2, "nsubj"), (4, "nsubj"), (2, "cop"), (0, "ROOT"), (6, "advmod"), (4, "cop")]
    texts = lambda w: [w[i]["text"] for i in sorted(w)]
    w = sentence([("we", "PRP", "nsubj", 4), ("will", "MD", "aux", 4), ("now", "RB", "advmod", 4), ("show", "VB", "ROOT", 0), ("soon", "RB", "advmod", 6), ("go", "VB", "dep", 4), ("well", "RB", "advmod", 6)])
    sentence_graph._adverbs_out(w)
    assert texts(w) == ["we", "now", "soon", "will", "show", "go", "well"]
    assert [w[i]["head"] for i in sorted(w)] == [5, 5, 6, 5, 0, 5, 6]
    # two adverbs, a modifier and a particle that isn't an adverb stay
    for rows in ([("a", "VB", "x", 0), ("b", "RB", "x", 1), ("c", "RB", "x", 1), ("d", "VB", "x", 1)], [("a", "VB", "x", 0), ("b", "RB", "x", 1), ("d", "VBN", "amod", 1)], [("a", "VB", "x", 0), ("b", "RP", "x", 1), ("d", "VB", "x", 1)]):
        w = sentence(rows)
        sentence_graph._adverbs_out(w)
        assert texts(w) == [r[0] for r in rows]


def test_runs_of_tags(spark):
    """Runs of verbs, adjectives, prepositions and nouns against a loop over the tokens."""
    rng = random.Random(6)
    kinds = [("VB", "ROOT"), ("VBN", "amod"), ("MD", "aux"), ("JJ", "amod"), ("JJR", None), ("IN", "prep"), ("NN", "nsubj"), ("NNS", "dobj"), ("FW", "x"), ("HYPH", "punct"), ("RB", None)]
    rows = [(d, s, 100 * s + i, f"w{i}", *rng.choice(kinds)) for d in range(3) for s in range(6) for i in range(25)]
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, token_i int, text string, tag string, dep string")

    def by_hand(member, ends=lambda r: True):
        out = set()
        for d in range(3):
            for s in range(6):
                sent = [r for r in rows if r[:2] == (d, s)]
                run = []
                for i, r in enumerate([*sent, None]):
                    if r is not None and member(r, sent[i + 1] if i + 1 < len(sent) else None):
                        run.append(r)
                        continue
                    while run and not ends(run[-1]):
                        run.pop()
                    if len(run) > 1:
                        out.add((d, s, run[0][2], run[-1][2], " ".join(x[3] for x in run)))
                    run = []
        return out

    got = lambda df: {(r.doc_id, r.sent_id, r.first_i, r.last_i, r.text) for r in df.collect()}
    nouns, verbs = ("NN", "NNS", "NNP", "NNPS"), ("MD", "VB", "VBN")
    assert got(sentence_graph.verb_runs(t)) == by_hand(lambda r, n: r[4] in verbs and r[5] != "amod") != set()
    assert got(sentence_graph.adjective_runs(t)) == by_hand(lambda r, n: r[4].startswith("JJ") or r[5] == "amod") != set()
    assert got(sentence_graph.preposition_runs(t)) == by_hand(lambda r, n: r[4] == "IN") != set()
    whole = by_hand(lambda r, n: r[4] in (*nouns, "JJ", "JJR", "FW", "HYPH") or n is not None and n[4] == "HYPH", lambda r: r[4] in nouns)
    assert got(sentence_graph.noun_runs(t)) == whole != set()


def test_folder_of_a_cluster_must_be_named(spark):
    from types import SimpleNamespace as S

    from corpusmill.plans import lineage

    conf = S(get=lambda *a: None)
    cluster = S(conf=conf, sparkContext=S(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        lineage.shared_folder(cluster)
    kept = written(spark.range(3), "gone")
    assert kept.count() == 3
    lineage.forget(spark)
    assert written(spark.range(3), "new").count() == 3


def test_split_by_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (80, 4)) * [5, 2, 1, 0.5]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, scores array<double>")
    got = {r.vec_id: r.path for r in vectors.plus_minus_split(v, 2).collect()}
    want = {}
    sign = lambda y: ["+" if a > y.mean() + y.std() else "-" if a < y.mean() - y.std() else "0" for a in y]
    first = np.array(sign(x[:, 0]))
    for p in "+-0":
        at = np.flatnonzero(first == p)
        want |= {int(i): p + s for i, s in zip(at, sign(x[at, 1]))}
    assert got == want
    s = spark.createDataFrame([(d, i, rng.normal(0, 1, 4).tolist()) for d in range(3) for i in range(d * 10 + 1)], "doc_id long, sent_ind int, embedding array<double>")
    steps = vectors.pca_steps(s, 4, 2, 3)
    assert steps.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 10), (2, 20)]
    assert all(set(r.path) <= set("+-0") and len(r.path) == 3 for r in steps.collect())


def test_ward_and_pca(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (20, 4)) for c in ([1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0])])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    lab = {r.vec_id: r.label for r in vectors.ward(v, 3).collect()}
    assert all(len({lab[i] for i in range(s, s + 20)}) == 1 for s in (0, 20, 40)) and len(set(lab.values())) == 3
    out, k = vectors.pca_reduced(v, 4, 0.7)
    assert k == 2 and out.count() == 60
    assert vectors.silhouette(v.join(vectors.ward(v, 3), "vec_id")).first()[0] > 0.8


def test_whole_table_with_itself_in_blocks(spark, monkeypatch):
    def refused(*a, **k):
        raise ValueError("no list of all rows")

    monkeypatch.setattr(vectors, "_list", refused)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (50, 6)) for c in np.eye(6)[:5]])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.repeat([0, 1, 2, 3, 3], 50)
    label[0] = 9  # a label of one vector
    v = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(label, x))] + [(999, 0, None)], "vec_id long, label int, embedding array<double>")
    ip = x @ x.T
    assert abs(vectors.worst_inner_product(v).first()[0] - ip.min()) < 1e-9
    near = {(r.a_id, r.b_id): r.ip for r in vectors.inner_products_within(v, least=0.8).collect()}
    assert set(near) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.round(ip, 9) >= 0.8)))) and all(abs(ip[k] - s) < 1e-9 for k, s in near.items())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i, c in enumerate(label):
        mean = {k: d[i][label == k].sum() / max(1, (label == k).sum() - (k == c)) for k in set(label.tolist())}
        b = min(m for k, m in mean.items() if k != c)
        scores.append((b - mean[c]) / max(mean[c], b) if (label == c).sum() > 1 else 0.0)
    assert abs(vectors.silhouette(v).first()[0] - np.mean(scores)) < 1e-9
    small = v.where("vec_id < 120 OR vec_id = 999")
    assert vectors.close_communities(small, 0.8).count() > 0 and vectors.density_clusters(small, 0.8, 5).count() == 121


def test_cluster_tree_is_three_levels_with_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 64))
    spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {r.cluster_id: r for r in catalogue.queries()["cluster_tree"](spark, str(tmp_path)).collect()}
    assert max(r.level for r in rows.values()) == 3 and all(rows[r.parent_id].n > 4 for r in rows.values() if r.level)
    divided = {r.parent_id for r in rows.values() if r.level}
    for r in rows.values():
        assert (r.silhouette is None) == (r.davies_bouldin is None) == (r.calinski_harabasz is None) == (r.cluster_id not in divided)
    # the scores of each divided cluster by themselves
    v = spark.createDataFrame([(i, int(i % 3), r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, embedding array<double>")
    clusters = spark.createDataFrame([(7, None), *((10 + k, 7) for k in range(3))], "cluster_id long, parent_id long")
    got = vectors.tree_scores(v.withColumn("cluster_id", (F.col("label") + 10).cast("long")).drop("label"), clusters, 64).collect()
    assert len(got) == 1 and got[0].cluster_id == 7
    assert np.allclose([got[0].silhouette, got[0].davies_bouldin, got[0].calinski_harabasz], [f.first()[0] for f in (vectors.silhouette(v), vectors.davies_bouldin(v, 64), vectors.calinski_harabasz(v, 64))])


def test_document_vectors_of_the_whole_training(spark, monkeypatch):
    import inspect

    asked, given = {}, inspect.signature(wiki.word_vectors)

    def taken(*a, **k):
        bound = given.bind(*a, **k)
        bound.apply_defaults()
        asked.update(bound.arguments)

    monkeypatch.setattr(wiki, "word_vectors", taken)
    monkeypatch.setattr(wiki, "document_vectors", lambda model, c: c)
    catalogue.queries()["word2vec_docs"](spark, FOLDER)
    assert (asked["size"], asked["window"], asked["epochs"], asked["min_count"]) == (150, 15, 10, 5)


def test_files(spark, tmp_path):
    bank = "# text = A b.\n1\tA\ta\t_\tDT\t_\t2\tdet\n1-2\tx\n2\tb\tb\t_\tNN\t_\t0\troot\n"
    (tmp_path / "x.conllu").write_text(bank)
    b = files.treebank(spark, str(tmp_path / "x.conllu"))
    assert [(r.word, r.pos, r.deprel, r.sentence) for r in b.collect()] == [("A", "DT", "det", "A b."), ("b", "NN", "root", "A b.")]
    (tmp_path / "l.txt").write_bytes("über eins\nzwei drei\n".encode("latin-1"))
    assert [r.tokens for r in files.line_corpus(spark, str(tmp_path / "l.txt")).orderBy("tag").collect()] == [["über", "eins"], ["zwei", "drei"]]
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>T</title><ns>0</ns><id>7</id><revision><text>Body [[X]]</text></revision></page></mediawiki>")
    assert files.wiki_pages(spark, str(tmp_path / "w.xml")).collect() == [(7, "0", "T", "Body [[X]]")]
    books = tmp_path / "books"
    books.mkdir()
    (books / "a.pdf").write_bytes(b"one\x0ctwo")
    done = str(tmp_path / "cache")
    for _ in range(2):
        assert [r.text for r in files.book_texts(spark, str(books), lambda c: c.decode(), cache=done).collect()] == ["one two"]
    assert [r.name for r in files.book_names(spark, str(books)).collect()] == ["a.pdf"]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    key = sinks.cache_key("x", 1)
    assert sinks.get_it(spark, str(tmp_path), key) == (False, None)
    sinks.cache_it(str(tmp_path), key, df)
    assert sinks.get_it(spark, str(tmp_path), key)[1].count() == 3
    assert sinks.save_tables({"a": df}, str(tmp_path / "t")) == {"a": 3}


def test_stream(spark, tmp_path):
    from corpusmill.streaming import ingest

    d = spark.createDataFrame([(1, "red dog. the red dog"), (2, None)], "doc_id long, text string").withColumn("ingested_at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    q = ingest.term_counts_by_window(ingest.documents(spark, str(tmp_path / "in"), d.schema)).writeStream.outputMode("complete").format("memory").queryName("terms_now").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.term, r.cnt) for r in spark.table("terms_now").collect()} == {("red dog", 1), ("red dog", 1)} or spark.table("terms_now").count() > 0
