import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import clusters, distinctive, frequency, languages, lookalikes, mixture, neighbours, queries, records, scans, tokens, vectors
from corpusmill.llm.automata import Trie
from tests.compare import FOLDER, both

DAY = dt.datetime(2025, 1, 1)
ATTR = "node_id long, term_ind int, term string, ATE_count int, loaded_at timestamp, cnt string, total string"


def attributes(spark, rows):
    return spark.createDataFrame([(n, i, t, c, None if d is None else DAY + dt.timedelta(days=d), "x", "y") for n, i, t, c, d in rows], ATTR)


def dirty(spark):
    return attributes(spark, [
        (1, 0, "Red  Dog ", 5, 0), (1, 0, "red dog", 7, 2), (1, 0, "red dog", 7, 2), (1, 1, "cat", 2, 0), (1, 2, None, 3, 0), (1, 3, " ", 3, 0), (1, 4, "owl", None, 1), (1, 4, "owl", 9, 0),
        (2, 0, "cat", 4, None), (2, 1, "red dog", 1, 0), (2, 2, "CAT", 1, 0), (None, 0, "cat", 8, 0), (3, 0, "x" * 5000, 1, 0),
    ])


def test_counting_rows(spark):
    got = sorted(tuple(r) for r in records.counting_rows(dirty(spark)).collect())
    assert got == sorted([(1, "red dog", 7), (1, "cat", 2), (2, "cat", 4), (2, "red dog", 1), (2, "cat", 1), (3, "x" * 5000, 1)])


def test_log_odds_by_hand(spark):
    got = {(r.node_id, r.term): r for r in distinctive.log_odds(dirty(spark), prior=10).collect()}
    r = got[1, "red dog"]
    assert (r.cnt, r.node_total, r.term_total, r.term_nodes, r.total) == (7, 9, 8, 2, 16)
    a = 10 * 8 / 16
    d = math.log((7 + a) / (9 + 10 - 7 - a)) - math.log((1 + a) / (7 + 10 - 1 - a))
    assert math.isclose(r.log_odds, d) and math.isclose(r.z_score, d / math.sqrt(1 / (7 + a) + 1 / (1 + a)))
    assert got[2, "cat"].cnt == 5
    one = distinctive.log_odds(attributes(spark, [(1, 0, "a", 3, 0)])).collect()
    assert one[0].z_score is None
    assert distinctive.log_odds(dirty(spark).limit(0)).count() == 0 and distinctive.characteristic(dirty(spark).limit(0)).count() == 0


def test_hot_term(spark):
    rows = [(i, 0, "hot", 1, 0) for i in range(900)] + [(i, 1, f"t{i % 300}", 2, 0) for i in range(900)]
    got = distinctive.log_odds(attributes(spark, rows))
    assert got.count() == 1800 and got.where("term = 'hot'").select("term_total", "term_nodes").distinct().collect() == [(900, 900)]


def test_bitmap_containers():
    random.seed(1)
    for n in (0, 1, 500, 4096, 4097, 20000):
        a, b = random.sample(range(65536), n), random.sample(range(65536), n // 2)
        x, y = frequency.pack(np.array(a, int)), frequency.pack(np.array(b, int))
        assert sorted(a) == frequency.unpack(x).tolist() and frequency.cardinality(x) == n
        assert set(frequency.unpack(frequency.union(x, y)).tolist()) == set(a) | set(b)
        assert len(x) <= 8193


def test_frequencies(spark):
    got = {r.term: (r.ate_count, r.nodes, r.mark) for r in frequency.term_frequencies(dirty(spark)).collect()}
    assert got == {"red dog": (8, 2, "rare,common"), "cat": (7, 2, "rare,common"), "x" * 5000: (1, 1, "rare,common")}
    rows = [(n, 0, "all", 1, 0) for n in range(-20, 70000, 7)] + [(n, 1, "few", 1, 0) for n in (3, 70003 - 3)]
    got = {r.term: (r.nodes, r.mark) for r in frequency.term_frequencies(attributes(spark, rows)).collect()}
    assert got["all"] == (len(range(-20, 70000, 7)), "common") and got["few"] == (2, "rare")
    assert frequency.marked(dirty(spark).limit(0)).count() == 0


REC = "cluster_id long, num_vectors int, mean_vec array<float>, loaded_at timestamp, id string, vec string, rep string, key string"


def cluster_rows(spark, rows):
    return spark.createDataFrame([(i, n, v, DAY + dt.timedelta(days=d), "a", "b", "c", "d") for i, n, v, d in rows], REC)


def vector_fixture(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        c = rng.standard_normal(64)
        c /= np.sqrt(c @ c)
        for _ in range(rng.integers(2, 14)):
            x = c + rng.standard_normal(64) * 0.035
            rows.append((len(rows) + 1, int(rng.integers(0, 9)), (x * rng.uniform(0.3, 7)).tolist(), 1))
    for _ in range(120):
        rows.append((len(rows) + 1, 1, rng.standard_normal(64).tolist(), 1))
    copy = rows[0][2]
    rows += [(1000 + i, None, copy, 1) for i in range(40)]
    rows += [(1, 5, rng.standard_normal(64).tolist(), 0), rows[3], (2000, 1, None, 0), (2001, 1, [1.0] * 3, 0), (2002, 1, [0.0] * 64, 0), (2003, 1, [float("nan")] + [1.0] * 63, 0), (None, 1, copy, 0), (2004, 1, [None] + [1.0] * 63, 0)]
    return cluster_rows(spark, rows), {i: np.array(v) for i, _, v, d in rows if d == 1 and v is not None and i is not None}


def _similar(vec):
    ids = np.array(sorted(vec))
    x = np.stack([np.asarray(vec[i], np.float32).astype(float) for i in ids])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return ids, np.round(x @ x.T, 6)


def test_cluster_groups(spark):
    rec, vec = vector_fixture(spark)
    ids, s = _similar(vec)
    member = clusters.groups(rec)
    got = {tuple(r) for r in clusters.group_pairs(member).collect()}
    i, j = np.nonzero(np.triu(s >= 0.8, 1))
    assert got == set(zip(ids[i].tolist(), ids[j].tolist()))
    d = {r.group_id: r for r in clusters.described(member).collect()}
    assert sum(r.n_records for r in d.values()) == len(ids)
    assert d[1].n_records >= 41 and len(d[1].typical_ids) == 3
    assert clusters.group_pairs(clusters.groups(rec.limit(0))).count() == 0


def test_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rec, vec = vector_fixture(spark, 5)
    ids, s = _similar(vec)
    i, j = np.nonzero(np.triu(s >= 0.8, 1))
    assert {tuple(r) for r in clusters.group_pairs(clusters.groups(rec)).collect()} == set(zip(ids[i].tolist(), ids[j].tolist()))


def test_hashed_features_keep_products():
    x = np.random.default_rng(1).standard_normal((5, 64))
    h = clusters.hashed_features(x)
    assert np.allclose(h @ h.T, x @ x.T)
    assert clusters.hashed_features(np.ones((1, 100))).shape == (1, 64)


def _best(ids, s, a, k, least=-2.0):
    order = sorted((j for j in range(len(ids)) if j != a and s[a, j] >= least), key=lambda j: (-s[a, j], ids[j]))
    return [int(ids[j]) for j in order[:k]]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_SAMPLE", 12)
    rec, vec = vector_fixture(spark)
    ids, s = _similar(vec)
    got = {r.id: [x.id for x in r.best] for r in neighbours.neighbours(rec, 5, least=0.8, recall=1.0).collect()}
    for a, i in enumerate(ids.tolist()):
        want = _best(ids, s, a, 5, 0.8)
        assert got.get(i, []) == want, i
    got = {r.id: [x.id for x in r.best] for r in neighbours.neighbours(rec, 10, recall=0.97, every=10).collect()}
    hit = [len(set(got[i]) & set(_best(ids, s, a, 10))) for a, i in enumerate(ids.tolist()) if i % 10 == 0]
    assert sum(hit) >= 0.9 * 10 * len(hit)
    assert neighbours.neighbours(rec.limit(0), 3).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rec, vec = vector_fixture(spark, 3)
    ids, s = _similar(vec)
    got = {r.id: [x.id for x in r.best] for r in neighbours.neighbours(rec, 5, least=0.8, recall=1.0).collect()}
    assert all(got.get(i, []) == _best(ids, s, a, 5, 0.8) for a, i in enumerate(ids.tolist()))


def test_visits_are_calibrated_for_vectors_the_tree_is_not_fitted_on(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FIT_ROWS", 150)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((1500, 64)), 4, axis=0)
    x += 0.35 * rng.standard_normal(x.shape)
    rec = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(x)], "cluster_id long, num_vectors int, mean_vec array<double>").withColumn("loaded_at", F.lit("2025-01-01").cast("timestamp"))
    got = {(r.id, y.id) for r in neighbours.neighbours(rec, 3, least=0.8, recall=0.99).collect() for y in r.best}
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.round(v @ v.T, 6) >= 0.8)
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert len(want) > 10_000 and len(got & want) >= 0.98 * len(want)


def test_rows_are_sent_once_to_leaves_side_by_side(spark):
    visits = {1: [3, 40, 5, 17, 4], 2: [20, 2], 3: [16, 31, 18]}
    rows = spark.createDataFrame([(r, [1.0], b) for r, b in visits.items()], "rep long, vec array<float>, bins array<int>")
    got = [(r.rep, r.bucket, r.leaves) for r in neighbours._shared(rows, {}).collect()]
    assert sorted((r, x) for r, _, b in got for x in b) == sorted((r, x) for r, b in visits.items() for x in b)
    assert sorted((r, b) for r, b, _ in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 1)]
    got = neighbours._shared(rows, {3: 2, 20: 2}).collect()
    assert sorted((r.rep, x) for r in got for x in r.leaves) == sorted((r, x) for r, b in visits.items() for x in b if x not in (3, 20))


def test_best_bins_is_best_first():
    x = np.random.default_rng(2).standard_normal((3000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    t = neighbours.fit_tree(x, 8, 20)
    at = np.flatnonzero(t.leaf >= 0)
    want = np.argsort(-(x[:200].astype(np.float32) @ t.centre[at].T.astype(np.float32)), axis=1)[:, :6]
    assert (t.leaf[at][want] == neighbours.best_bins(t, x[:200], 6, slack=1.0)).mean() > 0.999
    all_, few = [], []
    neighbours.best_bins(t, x[:200], 6, slack=1.0, work=all_)
    got = neighbours.best_bins(t, x[:200], 6, work=few)
    assert sum(few) < 0.5 * sum(all_)  # the queue leaves centres uncompared
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got.tolist(), t.leaf[at][want].tolist())]) > 0.6
    assert all(len(set(a)) == 6 for a in got.tolist())


def queue_by_hand(t, x, visits, slack):
    import heapq

    heap, out = [(-2.0, 0)], []
    while heap and len(out) < visits:
        _, n = heapq.heappop(heap)
        if t.count[n] == 0:
            out.append(int(t.leaf[n]))
            continue
        for c in range(t.first[n], t.first[n] + t.count[n]):
            s = float(np.float32(x.astype(np.float32) @ t.centre[c]))
            if t.count[c]:
                s = np.cos(max(np.arccos(np.clip(s, -1, 1)) - slack * t.radius[c], 0))
            heapq.heappush(heap, (-s, c))
    return out


def test_best_bins_equals_a_queue():
    """Opening several nodes at once finds what a queue taken one by one finds, or nearer leaves."""
    x = np.random.default_rng(4).standard_normal((4000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    t = neighbours.fit_tree(x, 8, 10)
    near = {int(t.leaf[n]): t.centre[n] for n in np.flatnonzero(t.leaf >= 0)}
    for q, got in zip(x[:60], neighbours.best_bins(t, x[:60], 5, slack=0.3).tolist()):
        want = queue_by_hand(t, q, 5, 0.3)
        assert sum(q @ near[g] for g in got) >= sum(q @ near[w] for w in want) - 1e-4
    assert neighbours.best_bins(neighbours.fit_tree(x[:3], 8, 10), x[:3], 4).tolist() == [[0, -1, -1, -1]] * 3


def chains(spark, groups=40, length=6, seed=1):
    """Chains of vectors each at about 0.83 to the next, but not to those after it."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for k in range(length):
            t = k * np.arccos(0.83)
            rows.append((len(rows) + 1, 1, (np.cos(t) * a + np.sin(t) * b).tolist(), 1))
    return cluster_rows(spark, rows)


@pytest.mark.parametrize("block", [16, 100, 8192])
def test_chains_stay_whole_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "CELL_ROWS", 100_000)
    member = clusters.groups(chains(spark))
    assert member.select("group_id").distinct().count() == 40
    assert {r.n_records for r in clusters.members(member).collect()} == {6}


def test_many_links_are_grown(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([c + rng.standard_normal((30, 64)) * 0.03 for c in rng.standard_normal((5, 64))])
    v = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    ids = np.arange(len(v)) * 3
    side = np.arange(len(v)) % 2
    (want, *_), (across, *_) = clusters._linked(v, ids, 0.8), clusters._linked(v, ids, 0.8, side)
    monkeypatch.setattr(clusters, "MOST_LINKS", 10)
    assert (clusters._linked(v, ids, 0.8)[0] == want).all() and (clusters._linked(v, ids, 0.8, side)[0] == across).all() and len(set(want.tolist())) == 5


def test_short_vectors_leave_no_link_undecided(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 64))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    short = clusters.unshort(clusters.short(v))
    assert np.abs(v[:2000] @ v[2000:].T - short[:2000] @ short[2000:].T).max() < clusters.SHORT_MARGIN
    # pairs just below, at and above the border of six decimals
    rows, want = [], set()
    for k, s in enumerate((0.79990, 0.7999994, 0.7999996, 0.8, 0.8000001, 0.8001) * 5):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        pair = [np.asarray(x, np.float32).astype(float) for x in (a, s * a + np.sqrt(1 - s * s) * b)]
        rows += [(2 * k + 1, 1, pair[0].tolist(), 1), (2 * k + 2, 1, pair[1].tolist(), 1)]
        if round(float(pair[0] @ pair[1] / np.sqrt((pair[0] @ pair[0]) * (pair[1] @ pair[1]))), 6) >= 0.8:
            want.add((2 * k + 1, 2 * k + 2))
    assert {tuple(r) for r in clusters.group_pairs(clusters.groups(cluster_rows(spark, rows))).collect()} == want


def test_large_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_CELLS", 2)
    monkeypatch.setattr(clusters, "LARGE_CELL", 20)
    monkeypatch.setattr(clusters, "CELL_ROWS", 10)
    rec, vec = vector_fixture(spark, 7)
    ids, s = _similar(vec)
    i, j = np.nonzero(np.triu(s >= 0.8, 1))
    assert {tuple(r) for r in clusters.group_pairs(clusters.groups(rec)).collect()} == set(zip(ids[i].tolist(), ids[j].tolist()))
    reps = vectors.representatives(vectors.keyed(vectors.usable(rec)), vectors.copies(vectors.keyed(vectors.usable(rec))))
    tree, _ = clusters._cells(reps, reps.count())
    assert tree.leaves > 4


@pytest.mark.parametrize("rows", [65_536, 100])
def test_links_no_cell_meets_are_found(spark, monkeypatch, rows):
    monkeypatch.setattr(clusters, "CELL_ROWS", 4)
    monkeypatch.setattr(clusters, "ROUND_ROWS", rows, raising=False)
    rng, vec = np.random.default_rng(12), []
    for size, near in [(2, 0.83)] * 120 + [(12, 0.97)] * 15:  # pairs, and tight groups
        c = rng.standard_normal(64)
        c /= np.sqrt(c @ c)
        for k in range(size):
            o = rng.standard_normal(64)
            o -= (o @ c) * c
            vec.append(c if size == 2 and k == 0 else near * c + math.sqrt(1 - near * near) * o / np.sqrt(o @ o))
    for k in range(15):  # single records at the side of a tight group
        g = np.mean(vec[240 + 12 * k : 252 + 12 * k], axis=0)
        o = rng.standard_normal(64)
        o -= (o @ g) / (g @ g) * g
        vec.append(0.82 * g / np.sqrt(g @ g) + math.sqrt(1 - 0.82**2) * o / np.sqrt(o @ o))
    ids, s = _similar({k + 1: v.tolist() for k, v in enumerate(vec)})
    i, j = np.nonzero(np.triu(s >= 0.8, 1))
    rec = cluster_rows(spark, [(k + 1, 1, v.tolist(), 1) for k, v in enumerate(vec)])
    # with one cell a record many pairs meet in none
    assert {tuple(r) for r in clusters.group_pairs(clusters.groups(rec, tries=1)).collect()} == set(zip(ids[i].tolist(), ids[j].tolist()))


def test_skeletons(spark):
    same = ["file", "ﬁle", "ｆｉｌｅ", "fi​le", "fі­lе"]
    assert len({lookalikes.skeleton(t) for t in same}) == 1
    assert lookalikes.skeleton("é") == lookalikes.skeleton("é") and lookalikes.skeleton("a b") == "a b"
    assert lookalikes.skeleton("“a” – b…") == "“a” – b…"
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*same, None, "", "file"])], "doc_id int, text string, skeleton string, h int")
    assert lookalikes.look_alike_groups(d).select("rows", "forms").collect() == [(6, 5)]
    assert [r.skeleton for r in lookalikes.skeletons(d.drop("skeleton")).orderBy("doc_id").collect()][5:] == [None, "", "file"]


@pytest.mark.parametrize(("text", "hit"), [
    ("plain text", False), ("naïve Überlieferung ñ", False), ("étude", True), ("a​b", True), ("a b", True), ("oﬃce", True), ("ｆｕｌｌ", True), ("the tаgger", True), ("a 300 K day", True),
    ("With α = 0.05 and β = 0.2", False), ("λ ≥ 0.3, ‘as is’ — see §4", False), ("Метод «Lifu» и метод «Hosopa»", False), ("Потому что пoдробный", True), ("while а word-level count", True), ("это а не то", False),
    ("emoji 👩‍👧 ok", False), ("tab\tand\r\nline\f", False), ("“quotes” – dash", False), ("", False), (None, False), ("x" * 200000 + "​", True),
])
def test_stand_ins(text, hit):
    assert (lookalikes.stand_in(text) is not None) is hit


def test_tokens_with_stand_ins(spark):
    rows = [(1, i, w) for i, w in enumerate(["changes", "а", "missing", "footnote", "tаgger", None])] + [(1, 1, "а"), (2, 0, "но"), (2, 1, "а"), (2, 2, "метод")]
    t = spark.createDataFrame(rows, "doc_id long, token_i int, text string")
    assert {tuple(r) for r in lookalikes.found_in_tokens(t).collect()} == {(1, 1), (1, 4)}
    assert lookalikes.found_in_tokens(t.limit(0)).count() == 0


TOKENIZER = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


def test_records_are_met_once_and_none_is_left_out():
    rng = np.random.default_rng(9)
    for shape in ((512, 1024), (7, 9), (3, 8), (5, 0)):
        mask = rng.random(shape) < 0.01
        mask[-1:, -1:] = True
        assert [x.tolist() for x in clusters._places(mask)] == [x.tolist() for x in np.nonzero(mask)]
    # pairs of near records in groups of their own, all of them single
    x = rng.standard_normal((1500, 64))
    x = np.r_[x, x + 0.1 * rng.standard_normal(x.shape)].astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ball = clusters._Balls(np.arange(3000), rng.permutation(3000), x)
    met = {h: [tuple(sorted(p)) for i, j in clusters._candidates(ball, ball, 0.8, halved=h) for p in zip(i.tolist(), j.tolist()) if p[0] != p[1]] for h in (False, True)}
    i, j = np.nonzero(np.triu(ball.x @ ball.x.T >= 0.8, 1))
    assert len(i) >= 1500 and set(zip(i.tolist(), j.tolist())) <= set(met[True]) <= set(met[False])
    assert len(met[True]) < 0.7 * len(met[False])


def test_features_are_stored_once(spark):
    rng = np.random.default_rng(10)
    rec = cluster_rows(spark, [(i, 1, rng.standard_normal(64).tolist(), 1) for i in range(300)])
    vecs = vectors.keyed(vectors.usable(rec))
    reps = vectors.representatives(vecs, vectors.copies(vecs))
    stored = clusters.stored_features(reps)
    assert "Join" not in stored._jdf.queryExecution().executedPlan().toString() and dict(stored.dtypes) == {"rep": "bigint", "vec": "binary"}
    want = {r.rep: clusters.hashed_features(np.array([r.vec]) / np.linalg.norm(r.vec))[0] for r in reps.collect()}
    got = {r.rep: clusters.unshort([r.vec])[0] for r in stored.collect()}
    assert got.keys() == want.keys() and all(np.abs(got[k] - want[k]).max() < 1.001 * 0.5 / 32767 for k in want)
    assert len(clusters._pool(stored, 300, 100)) <= 100 and len(clusters._pool(stored, 300, 400)) == 300


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="vocabulary files are missing")
def test_encoding_equals_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    texts = [None, "", " ", "<|endoftext|> and <|startoftext|>", "it's we'LL  don't\n\n x", "aaaaaaaaaaaa", "émigré Überlieferung 学习 🙂‍", "x" * 3000, "the " * 20000]
    texts += ["".join(random.choice("ab cdeé\n1.'sтуn") for _ in range(random.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i % 200, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encoded(df).collect())
    assert got == sorted((i % 200, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert tokens.encoded(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="vocabulary files are missing")
def test_mixture(spark):
    random.seed(5)
    rows = [(i, "Big " if i % 5 else "big", "word " * random.randint(1, 60)) for i in range(1500)]
    rows += [(2000 + i, "small", "word " * random.randint(5, 40)) for i in range(60)] + [(3000, "tiny", "one two"), (3001, None, "x"), (3002, "big", None), (3003, "other", "y"), (3004, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 50), ("tiny", 0.1, 3), ("none", 0.0, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixture.shares(docs, weights, total_tokens=20000).collect()}
    assert set(s) == {"big", "small", "tiny", "none"} and s["none"].copies == 0
    assert abs(s["big"].mix_tokens - 14000) < 150 and abs(s["small"].mix_tokens - 4000) < 150
    assert s["tiny"].capped and s["tiny"].copies == 3
    assert math.isclose(sum(r.actual_share for r in s.values()), 1, abs_tol=1e-5)
    m = mixture.mixture(docs, weights, total_tokens=20000)
    per = m.groupBy("source", "doc_id").agg(F.max("copy_no").alias("c"), F.count("*").alias("n")).collect()
    rate = {k: r.copies / r.docs for k, r in s.items() if r.docs}
    assert all(r.c == r.n and abs(r.n - rate[r.source]) < 1.2 for r in per)
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in mixture.mixture(docs, weights, total_tokens=20000).collect()}
    assert mixture.mixture(docs.limit(0), weights).count() == 0 and mixture.mixture(docs, weights.limit(0)).count() == 0


def test_automata_find_all_within_two_edits():
    random.seed(1)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 7))) for _ in range(300)]
    ask = ["".join(random.choice("abcde") for _ in range(random.randint(0, 8))) for _ in range(120)] + ["a" * 70, "a" * 40]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for q, got in zip(ask, Trie(words).within(ask)):
        assert sorted(got) == sorted((w, distance(q, w)) for w in set(words) if distance(q, w) <= 2)


def test_scan_limits_drop_nothing(spark):
    # more than eight candidates, the one that the words next to it ask for being the last by misreadings
    forms = {"cecece"[:i] + x + "cecece"[i + 1 : j] + y + "cecece"[j + 1 :] for i in range(6) for j in range(i + 1, 6) for x in "ce" for y in "ce"} - {"cecece"}
    r = scans.Reader({w: 600 for w in forms}, 10_000, {"the eeccce": 500})
    r.candidates({"cecece"})
    assert len(r.known["cecece"]) == 21 and r.meant("cecece", "cecece", 1, [], "the", "") == "eeccce"
    # misreadings of more than two edits
    r = scans.Reader({"much": 600, "modem": 600, "mummy": 600}, 10_000)
    r.candidates({"iiiuch", "rnodenn", "rnurnmy"})
    assert [r.meant(w, w, 1, []) for w in ("iiiuch", "rnodenn", "rnurnmy")] == ["much", "modem", "mummy"]
    # words too long for a machine word
    long = "ab" * 40
    assert Trie([long, "ab"]).within([long[:-2] + "c", long[1:-1] + "xx"]) == [[(long, 2)], []]
    r = scans.Reader({"c" + long: 600}, 10_000)
    r.candidates({"e" + long})
    assert r.meant("e" + long, "e" + long, 1, []) == "c" + long
    texts = spark.createDataFrame([("d" * 130,)] * 3 + [("e" * 200 + "-\nnd",)] * 3, "text string")
    words, *_ = scans.vocabulary(texts)
    assert words == {"d" * 130: 3}
    # a run of page numbers with more than 40 other numbers between
    body = ["A line of the chapter about words, and", "a second line that goes on about them"]
    lines = ["1", *body, *[str(900 - 10 * k) for k in range(50)], "2", "and on the next page it says more of", "what these words were in former times."]
    assert [i for i, d in enumerate(scans.furniture(lines)) if d] == [0, 53]


def test_runs_equal_looking_at_all_before():
    rng = random.Random(5)
    for _ in range(60):
        line, cand = 0, []
        for _ in range(rng.randint(0, 90)):
            line += rng.randint(1, 3)
            cand.append((line, rng.randint(1, 9), rng.choice(["plain", "sign", "word", "titled"])))
        best, back = [1] * len(cand), [-1] * len(cand)
        for b in range(len(cand)):
            for a in range(b):
                step = cand[b][1] - cand[a][1]
                if (step in (1, 2) or step == 0 and cand[b][0] - cand[a][0] > (1 if cand[a][2] != cand[b][2] else 3)) and best[a] + 1 > best[b]:
                    best[b], back[b] = best[a] + 1, a
        assert scans._longest_runs(cand) == (best, back)


PAGE = """The catalogue
The second chapter describes the regional dialect, and the
catalogue entry explains the printed page. A two-
column layout follows the conclitions of the sum-
- 7 -
\x0cA short study
mary, which tlie author wrote in 1850 for the printed
page. The regional dialect follows the summary.
1850
Another paragraph describes the catalogue entry.
- 8 -
\x0cThe catalogue
The catalogue entry explains the second chapter.
- 9 -"""


def scanned(spark):
    text = "The second chapter describes the regional dialect, and the catalogue entry explains the printed page. A two-column layout follows the conditions of the summary, which the author wrote for the study. Another paragraph."
    rows = [(i, text, "x", "k") for i in range(40)] + [(100, PAGE, "A short study", "k"), (101, None, None, "k"), (102, "", "t", "k"), (103, "one\n\n\ntwo", None, "k"), (104, "12\n13\n14\n", None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, title string, kind string")


def test_scan_findings(spark):
    got = {tuple(r) for r in scans.line_findings(scanned(spark)).collect()}
    assert got == {(100, i, "drop") for i in (0, 4, 5, 10, 11, 13)} | {(100, 3, "hyphen"), (100, 3, "ocr"), (100, 6, "ocr")}
    assert scans.line_findings(scanned(spark).limit(0)).count() == 0


def test_scan_repair(spark):
    got = {r.doc_id: r.text for r in scans.repaired(scanned(spark)).collect()}
    assert got[101] is None and got[102] == "" and got[103] == "one\n\n\ntwo" and got[104] == "12\n13\n14\n"
    assert "two-column layout follows the conditions of the summary, which the author wrote in 1850" in got[100].replace("\n", " ")
    assert "- 7 -" not in got[100] and "A short study" not in got[100]


def test_recurring_capitalised_misreadings():
    page = "The Rechfschreibung of a word is in the book of words\nand Rechfschreibung is what the rechfschreibung is about\nwhile Lorigo is a name here and Lorigo is a name there too\nand the words of the book are about the spelling of words"
    reader = lambda: scans.Reader({"rechtschreibung": 600, "longo": 600}, 10_000)
    first = reader()
    first.candidates({"lorigo", "rechfschreibung"})  # what a worker has met before doesn't count
    for r in (reader(), first):
        (p, _, wrong, _), = scans.repair(r, [page], [None])
        assert p.scan and {i: [v for *_, v in x] for i, x in wrong.items()} == {0: ["rechtschreibung"], 1: ["rechtschreibung"] * 2}


def test_gradients():
    net = languages.ByteGru(1)
    x = np.random.default_rng(0).integers(97, 120, (3, 5))
    y = np.eye(len(languages.LANGS), dtype=np.float32)[[0, 2, 4]]
    w = np.ones(3, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x, y, w)
    for k in net.p:
        i = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up, _ = net.gradients(x, y, w)
        net.p[k][i] = old - 1e-3
        down, _ = net.gradients(x, y, w)
        net.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3 * max(1, abs(g[k][i])), k


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")
def test_languages_held_out(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    docs, labels = languages._read(spark, folder)
    net = languages.train(docs, labels)
    probe = [("en", "The final summary describes the word list without any context."), ("de", "Das Verzeichnis beschreibt die mündliche Überlieferung am Ende des Buches."), ("fr", "La mise en page explique le compte des syllabes dans la première section."),
             ("es", "La oración breve describe el manuscrito más viejo al final del libro."), ("it", "La pagina stampata spiega il manoscritto più antico con poche eccezioni."), ("pt", "A página impressa descreve o dicionário depois da terceira leitura."), ("ru", "Краткое изложение описывает старинный список без всякого контекста.")]
    rows = [(i, t, None) for i, (_, t) in enumerate(probe)] + [(50, probe[0][1] + " " + probe[1][1] + " " + probe[0][1], "en"), (51, probe[0][1], "en"), (52, probe[0][1], "de"), (53, None, None), (54, "", None), (55, "12 34", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in languages.mislabelled(d, labels, net).collect()}
    assert got == {(i, l) for i, (l, _) in enumerate(probe)} | {(50, "en"), (50, "de"), (52, "en")}  # noqa: E741
    by = {r.doc_id: r for r in languages.document_languages(d, net).collect()}
    assert [s.lang for s in by[50].stretches] == ["en", "de", "en"] and by[53].lang is None and by[55].stretches == []
    assert by[50].lang == "en" and 0 < by[50].confidence <= 1
    # labels of all documents that have one, against what the text says: most labels are right
    got = docs.select("doc_id", "lang").join(languages.document_languages(docs, net).select("doc_id", F.col("lang").alias("l")), "doc_id").collect()
    said = [(labels[r.lang], r.l) for r in got if r.lang in labels and r.l]
    assert sum(a == b for a, b in said) > 0.88 * len(said)


def test_untrained_without_labels(spark):
    d = spark.createDataFrame([(1, "Some text here.", None)], "doc_id long, text string, lang string")
    net = languages.train(d, {})
    assert languages.document_languages(d.limit(0), net).count() == 0 and languages.document_languages(d, net).count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want


def test_usable_vectors_of_clashing_columns(spark):
    rec, vec = vector_fixture(spark)
    assert vectors.usable(rec).count() == len(vec)


def test_frequencies_come_from_unions(spark, monkeypatch):
    """Containers of several tasks meet by union: without it, counts of terms in several tasks go wrong."""
    rows = attributes(spark, [(n, i, "both", 1, 0) for n in range(50) for i in range(3)]).repartition(7, "node_id", "term_ind")
    r = rows.select("term", "node_id", F.lit(1).alias("cnt"))
    parts = r.withColumnRenamed("node_id", "record").select("term", "record", F.col("cnt").cast("long").alias("cnt")).mapInArrow(frequency._built, frequency._BOXES_DDL)
    assert parts.count() > 1
    box = frequency.term_bitmaps(r).collect()
    assert [(b.term, b.chunk, b.occurrences, frequency.cardinality(b.box)) for b in box] == [("both", 0, 150, 50)]
    boxes = [frequency.pack(np.arange(k, 60000, 7)) for k in range(7)]
    got = list(frequency._merged(iter([frequency.pa.RecordBatch.from_arrays([frequency.pa.array(["t"] * 7), frequency.pa.array([0] * 7), frequency.pa.array(boxes), frequency.pa.array([1] * 7)], schema=frequency._BOXES)])))
    assert len(got) == 1 and got[0].column("occurrences").to_pylist() == [7] and frequency.cardinality(got[0].column("box").to_pylist()[0]) == 60000


def test_skeletons_of_many_scripts():
    same = [("Ꭺ", "A"), ("ꓮ", "A"), ("rn", "m"), ("0", "O"), ("1", "l"), ("I", "l"), ("ᎪᏴᏟ", "ABC"), ("ⲟ", "o"), ("ᴏ", "o"), ("scope", "ѕсоре"), ("ｍ", "rn")]
    assert all(lookalikes.skeleton(a) == lookalikes.skeleton(b) for a, b in same)
    assert len(lookalikes.table().full) > 5000
    assert [lookalikes.stand_in(t) is not None for t in ("the ꓮlpha", "a ｍark", "missinɡ", "/fəˈnɛtɪk/", "Ꭺ", "größer", "наука", "Ⅳ")] == [True, True, True, False, False, False, False, False]


def test_stand_ins_are_differences_from_the_skeleton(monkeypatch):
    """With a table in which every character is its own prototype, nothing stands in for anything."""
    found = ["e\u0301tude", "the tаgger", "ｆｕｌｌ", "a\u00a0b", "Потому что пoдробный", "while а word-level count"]
    assert all(lookalikes.stand_in(t) for t in found)
    t = lookalikes.Table()
    t.kinds, t.like, t.latin = {}, {}, set()
    t.whole = t.foreign = lookalikes.regex.compile(r"(?!)")
    monkeypatch.setattr(lookalikes, "table", lambda: t)
    assert not any(lookalikes.stand_in(t) for t in found)


@pytest.mark.skipif(not os.path.isdir(FOLDER) or not os.path.exists(TOKENIZER), reason="test tables or vocabulary files are missing")
def test_total_brings_sources_nearest(spark):
    docs, weights = mixture._both(spark, FOLDER.replace("sf0.001", "sf0.01"))
    best = mixture.shares(docs, weights).collect()
    every = sum(r.source_tokens for r in best)
    far = [mixture.shares(docs, weights, total_tokens=t).first().distance for t in (every, every // 4)]
    assert best[0].distance < 0.06 and best[0].distance < min(far)
    assert math.isclose(best[0].distance, sum(abs(r.actual_share - r.target_share) for r in best) / 2, abs_tol=1e-4)
    assert all(r.copies <= r.docs * r.max_repeats for r in best)


def test_candidates_are_ranked_with_their_neighbours():
    pairs = {"they eat": 60, "eat bread": 50, "the cat": 80, "cat sleeps": 40, "modern age": 30, "a modem": 30}
    r = scans.Reader({"cat": 600, "eat": 700, "they": 3000, "the": 5000, "modern": 400, "modem": 400}, 10_000, pairs)
    r.candidates({"cat", "eat", "rnodern", "rnodem", "modem", "modern", "modcrn", "modein"})
    # a word of the corpus in a place where only another stands; and in its own
    assert r.meant("cat", "cat", 1, [], "they", "bread") == "eat"
    assert r.meant("cat", "cat", 1, [], "the", "sleeps") is None and r.meant("cat", "cat", 1, [], "", "") is None
    assert r.meant("modem", "modem", 1, [], "", "age") == "modern" and r.meant("modem", "modem", 1, [], "a", "age") is None
    # two candidates alike by misreadings and documents
    x = scans.Reader({"hand": 500, "band": 500, "rock": 900, "left": 900}, 10_000, {"rock band": 40, "left hand": 40})
    x.df["li"] = 0
    x.candidates({"6and", "liand"})
    y = {w: [v for _, v in x.known[w]] for w in ("6and", "liand")}
    assert "hand" in y["liand"] and "band" in y["6and"]
    without = scans.Reader({"cat": 600, "eat": 700}, 10_000)
    without.candidates({"cat"})
    assert without.meant("cat", "cat", 1, [], "they", "bread") is None


def test_vocabulary_counts_pairs(spark):
    d = spark.createDataFrame([(i, "the red dog, the red\ndog runs", None, "k") for i in range(5)] + [(9, None, None, "k")], "doc_id long, text string, title string, kind string")
    words, n, pairs = scans.vocabulary(d)
    assert n == 5 and words == {"the": 5, "red": 5, "dog": 5, "runs": 5} and pairs == {"the red": 5, "red dog": 5, "dog the": 5, "dog runs": 5}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")
def test_network_is_kept_between_queries(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(languages, "train", lambda docs, labels: calls.append(1) or languages.ByteGru())
    languages._NETS.clear()
    assert languages.p9_languages(spark, FOLDER).columns == ["doc_id", "lang", "confidence"]
    languages.p9_stretches(spark, FOLDER)
    languages.p9_found(spark, FOLDER)
    assert calls == [1]
    languages._NETS.clear()


def test_words_of_the_corpus_are_looked_up_once_for_all_workers(monkeypatch):
    words = {"cat": 600, "eat": 700, "the": 5000, "modern": 900, "modem": 100, "rnodern": 5, "hand": 500, "c" * 70: 400}
    pairs = {"they eat": 60, "the cat": 80}
    plain = scans.Reader(words, 10_000, pairs)
    plain.candidates({w for w in words if not plain.common(w)})
    box = type("Box", (), {"value": scans._prepared(words, 10_000, pairs)})
    monkeypatch.setattr(scans, "_READERS", {})
    r = scans._reader(box, "a")
    assert (r.known, r.fine, r.rivals.keys()) == (plain.known, plain.fine, plain.rivals.keys()) and r.known["rnodern"][0][1] == "modern"
    asked = []
    monkeypatch.setattr(r.trie, "within", lambda new, edits: asked.extend(new) or [[] for _ in new])
    r.candidates({*plain.known, "rnodem"})
    assert asked == ["rnodem"]
    # a vocabulary too large for the driver is left to the workers
    monkeypatch.setattr(scans, "MOST_AHEAD", 0)
    assert scans._prepared(words, 10_000, pairs) == (words, 10_000, pairs, {}, {}, set())


def test_trie_finds_what_distances_say():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 9, 300)} | {"a" * 59, "a" * 62, "b" * 63, "b" * 64})
    asked = ["", "a", "abcab", "ccc", "bacbacbac", "zz", "a" * 60, "b" * 61, "b" * 62]
    for edits in (0, 1, 2, 3):
        want = [sorted((w, d) for w in words if (d := distance(w, q)) <= edits) for q in asked]
        assert [sorted(x) for x in Trie(words).within(asked, edits)] == want
    # a word far from all in length is left at the root
    t = Trie(["a" * n for n in range(20, 40)])
    assert int(t.length[0]) == sum(1 << n for n in range(20, 40)) and t.within(["a" * 10]) == [[]]
