"""Parsed sentences as typed graphs of words and phrases.

Tokens are rows (doc_id, sent_id, token_i, text, lemma, tag, dep, head_i); a constituency tree is rows
(doc_id, sent_id, uid, parent_uid, child_pos, label, level, word_id, subsentence_uid, size). Edges are (doc_id, src,
dst, kind, extra). Sentences are the partitions of all windows; only retokenization changes words in
turn and works on a sentence at a time in Python.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.labels import ADVERB_TAGS, CLAUSES, NOUN_TAGS, RELATIVE, SUBJECTS, VERB_TAGS, adjective_like, clause_level, noun_like, phrase_level, verb_like, wh_word

_SENT = ("doc_id", "sent_id")


def words_of(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, word_id, head_id, token_i, text, lemma, tag, dep): ids from 1 within the
    sentence, head 0 at a root or where the head isn't in the sentence. Repeated tokens count once."""
    t = tokens.where("token_i IS NOT NULL").dropDuplicates(["doc_id", "sent_id", "token_i"]).withColumn("word_id", F.row_number().over(W.partitionBy(*_SENT).orderBy("token_i")).cast("long"))
    h = t.select(*_SENT, F.col("token_i").alias("head_i"), F.col("word_id").alias("head_id"))
    return t.join(h, [*_SENT, "head_i"], "left").select(*_SENT, "word_id", F.coalesce("head_id", F.lit(0)).alias("head_id"), "token_i", "text", "lemma", "tag", "dep")


def runs(tokens: DataFrame, member, order: str = "token_i") -> DataFrame:
    """(doc_id, sent_id, first_i, last_i, n, text): maximal runs of neighbouring tokens for which
    the predicate `member` holds, of two tokens or more."""
    w = W.partitionBy(*_SENT).orderBy(order)
    t = tokens.dropDuplicates([*_SENT, order]).withColumn("_m", F.coalesce(member, F.lit(False))).withColumn("_i", F.row_number().over(w))
    t = t.where("_m").withColumn("_g", F.col("_i") - F.row_number().over(w))
    g = t.groupBy(*_SENT, "_g").agg(F.min(order).alias("first_i"), F.max(order).alias("last_i"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
    return g.where("n > 1").drop("_g")


def verb_runs(tokens: DataFrame) -> DataFrame:
    """Runs of verb tags that aren't adjectival modifiers."""
    return runs(tokens, F.col("tag").isin(*VERB_TAGS) & (F.coalesce("dep", F.lit("")) != "amod"))


def adjective_runs(tokens: DataFrame) -> DataFrame:
    """G8."""
    return runs(tokens, F.col("tag").startswith("JJ") | (F.col("dep") == "amod"))


def preposition_runs(tokens: DataFrame) -> DataFrame:
    """G9."""
    return runs(tokens, F.col("tag") == "IN")


def noun_runs(tokens: DataFrame) -> DataFrame:
    """Runs that end in a noun, of nouns, adjectives, foreign words, hyphens, and the word before a hyphen."""
    w = W.partitionBy(*_SENT).orderBy("token_i")
    hyphen = lambda tag, text: (tag == "HYPH") | text.isin("–")
    t = tokens.dropDuplicates([*_SENT, "token_i"]).withColumn("_next", F.coalesce(hyphen(F.lead("tag").over(w), F.lead("text").over(w)), F.lit(False)))
    part = F.col("tag").isin(*NOUN_TAGS, "JJ", "JJR", "JJS", "FW") | hyphen(F.col("tag"), F.col("text")) | F.col("_next")
    t = t.withColumn("_m", F.coalesce(part, F.lit(False))).withColumn("_i", F.row_number().over(w)).where("_m").withColumn("_g", F.col("_i") - F.row_number().over(w))
    last = F.max(F.when(F.col("tag").isin(*NOUN_TAGS), F.col("token_i"))).over(W.partitionBy(*_SENT, "_g"))
    t = t.withColumn("_last", last).where(F.col("token_i") <= F.col("_last"))
    g = t.groupBy(*_SENT, "_g").agg(F.min("token_i").alias("first_i"), F.max("token_i").alias("last_i"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_i", "text"))), lambda x: x["text"]), " ").alias("text"))
    return g.where("n > 1").drop("_g")


def _copulas(w: dict) -> None:
    """The copula of a predicate takes its place in the tree, the predicate becomes its child, and the predicate's
    subjects turn to it. Of several copulas of one predicate the first does; one whose head is itself a copula
    stays. All new heads follow from the pairs of the sentence as it came."""
    stands_for = {x["head"]: i for i, x in sorted(w.items(), reverse=True) if x["dep"] == "cop" and x["head"] in w and w[x["head"]]["dep"] != "cop"}
    new = {h: (i, "cop") for h, i in stands_for.items()}
    new |= {i: (stands_for.get(w[h]["head"], w[h]["head"]) if w[h]["dep"] in SUBJECTS else w[h]["head"], w[h]["dep"]) for h, i in stands_for.items()}
    for i, x in w.items():
        if i not in new and x["dep"] in SUBJECTS and x["head"] in stands_for:
            new[i] = (stands_for[x["head"]], x["dep"])
    for i, (head, dep) in new.items():
        w[i] |= {"head": head, "dep": dep}


def _adverbs_out(w: dict) -> None:
    """An adverb alone between two verbs moves before the run of verbs it stands in, after those moved before it.
    One pass gives the new order of the words; places and heads follow from it. Adjectival modifiers are
    no verbs here."""
    ids = sorted(w)
    verb = [w[i]["tag"] in VERB_TAGS and w[i]["dep"] != "amod" for i in ids]
    order: list[int] = []
    begin = None  # where the run of verbs begins in the new order
    for k, i in enumerate(ids):
        if verb[k]:
            begin = len(order) if begin is None else begin
            order.append(i)
        elif begin is not None and w[i]["tag"] in ADVERB_TAGS and k + 1 < len(ids) and verb[k + 1]:
            order.insert(begin, i)
            begin += 1
        else:
            begin = None
            order.append(i)
    if order != ids:
        place = dict(zip(order, ids))
        moved = {place[i]: x | {"head": place.get(x["head"], x["head"])} for i, x in w.items()}
        w.clear()
        w.update(moved)


def _compounds(w: dict, member, ends) -> list[list[int]]:
    out, run, ids = [], [], sorted(w)
    for k, i in enumerate(ids):
        if member(i, ids[k + 1] if k + 1 < len(ids) else None):
            run.append(i)
        else:
            out.append(run)
            run = []
    out.append(run)
    for r in out:
        while r and not ends(r[-1]):
            r.pop()
    return [r for r in out if len(r) > 1]


def retokenized(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, word_id, head_id, token_i, text, lemma, tag, dep) after copulas took
    their heads' places, adverbs left verb groups, and runs of nouns, verbs, adjectives and prepositions
    became one word each (the last, with the texts joined and heads redirected; an empty text as a line
    end). Ids run from 1. A sentence is the unit of work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_id")
        w = {int(r.word_id): {"head": int(r.head_id), "token_i": int(r.token_i), "text": r.text or "", "lemma": r.lemma or r.text or "", "tag": r.tag or "", "dep": r.dep or ""} for r in pdf.itertuples()}
        _copulas(w)
        _adverbs_out(w)
        hyphen = lambda i: w[i]["tag"] == "HYPH" or w[i]["text"] == "–"
        kinds = (
            (lambda i, n: w[i]["tag"] in (*NOUN_TAGS, "JJ", "JJR", "JJS", "FW") or hyphen(i) or n is not None and hyphen(n), lambda i: w[i]["tag"] in NOUN_TAGS),
            (lambda i, n: w[i]["tag"] in VERB_TAGS and w[i]["dep"] != "amod", lambda i: True),
            (lambda i, n: w[i]["tag"].startswith("JJ") or w[i]["dep"] == "amod", lambda i: True),
            (lambda i, n: w[i]["tag"] == "IN", lambda i: True),
        )
        for member, ends in kinds:
            for group in _compounds(w, member, ends):
                last = group[-1]
                inside = set(group)
                heads = [w[i]["head"] for i in group if w[i]["head"] not in inside]
                top = next((i for i in group if w[i]["head"] not in inside), last)
                w[last] |= {"text": " ".join(w[i]["text"] for i in group).strip() or "\n", "lemma": " ".join(w[i]["lemma"] for i in group).strip(), "head": heads[0] if heads else 0, "dep": w[top]["dep"]}
                for i in group[:-1]:
                    del w[i]
                for x in w.values():
                    if x["head"] in inside:
                        x["head"] = last
                if w[last]["head"] == last:
                    w[last]["head"] = 0
        new = {i: k + 1 for k, i in enumerate(sorted(w))}
        rows = [(new[i], new.get(x["head"], 0), x["token_i"], x["text"] or "\n", x["lemma"], x["tag"], x["dep"]) for i, x in sorted(w.items())]
        out = pd.DataFrame(rows, columns=["word_id", "head_id", "token_i", "text", "lemma", "tag", "dep"])
        out.insert(0, "sent_id", pdf["sent_id"].iat[0])
        out.insert(0, "doc_id", pdf["doc_id"].iat[0])
        return out

    t = words_of(tokens.where("doc_id IS NOT NULL AND sent_id IS NOT NULL"))
    return t.groupBy(*_SENT).applyInPandas(run, "doc_id long, sent_id int, word_id long, head_id long, token_i int, text string, lemma string, tag string, dep string")


def _uid(sent, tok):
    return F.concat(sent.cast("string"), F.lit("."), tok.cast("string"))


def dependency_edges(words: DataFrame) -> DataFrame:
    """(doc_id, src, dst, kind, extra): head to word, kind `TAG:dep`; `conj` both ways. src and dst are
    `sent_id.word_id`."""
    h = words.select(*_SENT, F.col("word_id").alias("head_id"))
    e = words.where("head_id <> 0").join(h, [*_SENT, "head_id"])
    e = e.select("doc_id", _uid(F.col("sent_id"), F.col("head_id")).alias("src"), _uid(F.col("sent_id"), F.col("word_id")).alias("dst"), F.concat_ws(":", "tag", "dep").alias("kind"), F.lit("dependency").alias("extra"), "dep")
    back = e.where("dep = 'conj'").select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CONJ").alias("kind"), "extra", "dep")
    return e.union(back).drop("dep")


def word_order_edges(words: DataFrame) -> DataFrame:
    """Each word of a sentence to the next."""
    w = W.partitionBy(*_SENT).orderBy("word_id")
    e = words.withColumn("_p", F.lag("word_id").over(w)).where("_p IS NOT NULL")
    return e.select("doc_id", _uid(F.col("sent_id"), F.col("_p")).alias("src"), _uid(F.col("sent_id"), F.col("word_id")).alias("dst"), F.lit("original order").alias("kind"), F.lit("order").alias("extra"))


def identical_noun_edges(words: DataFrame) -> DataFrame:
    """(doc_id, src, dst, kind, extra) between nouns of one lemma, both ways. A lemma of a document
    stands in a chain of its places, each to the next, so the links grow with the nouns and not with
    their pairs; those that are linked are the same."""
    n = words.where(F.col("tag").isin(*NOUN_TAGS) & F.col("lemma").isNotNull())
    w = W.partitionBy("doc_id", "lemma").orderBy("sent_id", "word_id")
    u = n.withColumn("u", _uid(F.col("sent_id"), F.col("word_id"))).withColumn("v", F.lead("u").over(w)).where("v IS NOT NULL")
    return u.select("doc_id", F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("doc_id", "e.src", "e.dst", F.lit("identical_nouns").alias("kind"), F.lit("noun").alias("extra"))


def identical_noun_pairs(words: DataFrame) -> DataFrame:
    """J7 in full, the small-document form: (doc_id, a, b), a before b, all pairs of a lemma in a document. The
    chain of identical_noun_edges() links the same nouns with a row each."""
    n = words.where(F.col("tag").isin(*NOUN_TAGS) & F.col("lemma").isNotNull()).select("doc_id", "lemma", "token_i")
    b = n.select("doc_id", "lemma", F.col("token_i").alias("b"))
    return n.withColumnRenamed("token_i", "a").join(b, ["doc_id", "lemma"]).where("a < b").select("doc_id", "a", "b")


def coreference_edges(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mentions (doc_id, uid, all_coref_i) to the nodes (doc_id, uid, token_i) they refer to, both ways."""
    m = mentions.select("doc_id", F.col("uid").alias("src"), F.explode("all_coref_i").alias("token_i"))
    e = m.join(nodes.select("doc_id", F.col("uid").alias("dst"), "token_i"), ["doc_id", "token_i"]).where("src <> dst").select("doc_id", "src", "dst")
    return e.union(e.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumns({"kind": F.lit("coref_res"), "extra": F.lit("coref")})


def relative_resolutions(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, word_id, version, target): for a WH word within a relative clause the closest noun
    before it (v1), the head of its head (v2), and the head of the relative clause (v3)."""
    prev = F.last(F.when(F.col("tag").isin(*NOUN_TAGS), F.col("word_id")), True).over(W.partitionBy(*_SENT).orderBy("word_id").rowsBetween(W.unboundedPreceding, -1))
    w = words.withColumn("_v1", prev).where(wh_word(F.col("tag"), F.col("dep")))
    h = words.select(*_SENT, F.col("word_id").alias("head_id"), F.col("head_id").alias("_g"), F.col("dep").alias("_hd"))
    g = words.select(*_SENT, F.col("word_id").alias("_g"), F.col("head_id").alias("_gg"), F.col("dep").alias("_gd"))
    j = w.join(h, [*_SENT, "head_id"]).join(g, [*_SENT, "_g"], "left")
    v3 = F.when(F.col("_hd").isin(*RELATIVE), F.col("_g")).when(F.col("_gd").isin(*RELATIVE), F.col("_gg"))
    j = j.where(F.col("_hd").isin(*RELATIVE) | F.col("_gd").isin(*RELATIVE))
    v = F.array(*[F.struct(F.lit(n).alias("version"), t.alias("target")) for n, t in (("WH-res v1", F.col("_v1")), ("WH-res v2", F.col("_g")), ("WH-res v3", v3))])
    return j.select(*_SENT, "word_id", F.explode(v).alias("x")).select(*_SENT, "word_id", "x.version", "x.target").where("target IS NOT NULL AND target <> 0")


def resolved_references(words: DataFrame, mentions: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, token_i, target_i): WH words to the head of the relative clause they stand in; mentions
    (doc_id, cluster_id, mention_pos, first_i) to the first of their cluster; chains followed to their
    end. Pointers are doubled each round, so `most` steps take log2(most) rounds."""
    from corpusmill.plans.lineage import written

    t = words.select(*_SENT, F.col("word_id").alias("head_id"), F.col("head_id").alias("_g"), F.col("dep").alias("_hd"))
    g = words.select(*_SENT, F.col("word_id").alias("_g"), F.col("token_i").alias("target_i"))
    wh = words.where(wh_word(F.col("tag"), F.col("dep"))).join(t.where(F.col("_hd").isin(*RELATIVE)), [*_SENT, "head_id"]).join(g, [*_SENT, "_g"]).select("doc_id", "token_i", "target_i")
    first = mentions.groupBy("doc_id", "cluster_id").agg(F.min_by("first_i", "mention_pos").alias("target_i"))
    co = mentions.join(first, ["doc_id", "cluster_id"]).where("first_i <> target_i").select("doc_id", F.col("first_i").alias("token_i"), "target_i")
    step = wh.union(co).groupBy("doc_id", "token_i").agg(F.min("target_i").alias("target_i"))
    step, reach = written(step, "step"), 1
    while reach < most:
        nxt = step.select("doc_id", F.col("token_i").alias("target_i"), F.col("target_i").alias("_t"))
        j = step.join(nxt, ["doc_id", "target_i"], "left")
        if j.where("_t IS NOT NULL AND _t <> token_i").isEmpty():
            break
        step = written(j.select("doc_id", "token_i", F.when(F.col("_t").isNull() | (F.col("_t") == F.col("token_i")), F.col("target_i")).otherwise(F.col("_t")).alias("target_i")), "step")
        reach *= 2
    return step


def sentence_starts(tokens: DataFrame, marker: str) -> DataFrame:
    """Tokens with sent_id numbered anew: a sentence begins after each marker token only."""
    w = W.partitionBy("doc_id").orderBy("token_i").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("sent_id", F.coalesce(F.sum((F.col("text") == marker).cast("int")).over(w), F.lit(0)).cast("int"))


# --- constituency trees ---------------------------------------------------------------------------


def numbered_tree(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Tree rows (doc_id, sent_id, node, parent, child_pos, label, word_id) with uid (pre-order),
    parent_uid, level, subsentence_uid (nearest clause above or itself; the root is its own) and size, the
    nodes below and itself. Node ids are the caller's; the prefix may hold no colon. A sentence's tree is one
    unit of work, many are worked through in a batch; nodes whose parent is missing are left out. Children of the same child_pos stand in order of node."""
    if ":" in prefix:
        raise ValueError("a prefix may not hold a colon")

    kind = "doc_id long, sent_id int, uid string, parent_uid string, child_pos int, label string, level int, word_id long, subsentence_uid string, size int"

    def numbered(doc, sent, of: list[tuple]) -> list[list]:
        kids: dict = {}
        info = {}
        for r in of:
            info[r[1]] = r
            kids.setdefault(r[2], []).append(r[1])
        rows: list[list] = []
        todo = [(n, None, None, 0, None) for n in reversed(kids.get(None, []))]
        ups = []
        while todo:
            n, up_no, up, level, sub = todo.pop()
            (pos, _, _, label, word), no = info[n], len(rows)
            uid = f"{prefix}{sent}-{no:06d}"
            sub = uid if up is None or label in CLAUSES else sub
            rows.append([doc, sent, uid, up, pos, label, level, word, sub, 1])
            ups.append(up_no)
            todo += [(k, no, uid, level + 1, sub) for k in reversed(kids.get(n, []))]
        for no in range(len(rows) - 1, -1, -1):
            if ups[no] is not None:
                rows[ups[no]][-1] += rows[no][-1]
        return rows

    def run(batches):
        schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for c, t in (x.split() for x in kind.split(", "))])
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                p, rows, at = b.slice(s, 1024), [], 0
                of = list(zip(*(x.to_pylist() for x in p.column("of").flatten().flatten())))
                for doc, sent, n in zip(p.column("doc_id").to_pylist(), p.column("sent_id").to_pylist(), p.column("of").value_lengths().to_pylist()):
                    rows += numbered(doc, sent, of[at : at + n])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    # rows of a sentence are gathered, not only sorted: a repartition of a union may be left out by the optimizer, and its parts then lie apart
    of = nodes.groupBy(*_SENT).agg(F.sort_array(F.collect_list(F.struct("child_pos", "node", "parent", "label", "word_id"))).alias("of"))
    return of.mapInArrow(run, kind)


def covered_words(tree: DataFrame) -> DataFrame:
    """(doc_id, sent_id, uid, word_id): the words below each node. Ids end in
    the place in pre-order, so a node's words are those of its own place and the size - 1 after it: one row a
    node and place, joined to the words by place. Nodes taken out of the tree don't matter. The join is a merge,
    as a table of words is many times as large in memory as on disk, by which a broadcast is chosen."""
    t = tree.withColumn("_at", F.substring_index("uid", "-", -1).cast("int"))
    s = t.select(*_SENT, "uid", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("size") - 1)).alias("_at"))
    return s.join(t.where("word_id IS NOT NULL").select(*_SENT, "_at", "word_id").hint("merge"), [*_SENT, "_at"]).select(*_SENT, "uid", "word_id")


def unresolved_heads(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, uid, head_id, dep): heads of a node's words that lie outside of it; head 0 always does.
    A head lies outside if none of its places in pre-order is the node's own or one of the size - 1 after it."""
    t = tree.withColumn("_at", F.substring_index("uid", "-", -1).cast("int"))
    places = t.where("word_id IS NOT NULL").select(*_SENT, "word_id", "_at")
    heads = places.groupBy(*_SENT, F.col("word_id").alias("head_id")).agg(F.collect_list("_at").alias("_in"))
    w = words.select(*_SENT, "word_id", "head_id", "dep").join(places.hint("merge"), [*_SENT, "word_id"]).join(heads.hint("merge"), [*_SENT, "head_id"], "left")
    last = F.col("_from") + F.col("size") - 1
    s = t.select(*_SENT, "uid", F.col("_at").alias("_from"), "size").withColumn("_at", F.explode(F.sequence("_from", last)))
    j = s.join(w.select(*_SENT, "_at", "head_id", "dep", "_in").hint("merge"), [*_SENT, "_at"])
    return j.where(~F.coalesce(F.exists("_in", lambda x: x.between(F.col("_from"), last)), F.lit(False))).select(*_SENT, "uid", "head_id", "dep").distinct()


def highest_nodes(unresolved: DataFrame) -> DataFrame:
    """(doc_id, sent_id, head_id, dep, uid): the first node in pre-order for each head and relation."""
    return unresolved.groupBy(*_SENT, "head_id", "dep").agg(F.min("uid").alias("uid"))


def dependency_children(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, head_id, children) in order."""
    return words.groupBy(*_SENT, "head_id").agg(F.sort_array(F.collect_list("word_id")).alias("children"))


def tree_text(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, uid, text): the words of each node in order, joined by spaces."""
    c = covered_words(tree).join(words.select(*_SENT, "word_id", "text"), [*_SENT, "word_id"])
    return c.groupBy(*_SENT, "uid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "text"))), lambda x: x["text"]), " ").alias("text"))


def without_punctuation(tree: DataFrame, words: DataFrame) -> DataFrame:
    """the tree without preterminals of punctuation that have siblings."""
    n = F.count("*").over(W.partitionBy(*_SENT, "parent_uid"))
    p = words.where("dep = 'punct'").select(*_SENT, "word_id", F.lit(True).alias("_p"))
    return tree.withColumn("_n", n).join(p, [*_SENT, "word_id"], "left").where("NOT (coalesce(_p, false) AND _n > 1)").drop("_n", "_p").select(*tree.columns)


def invalid_trees(tree: DataFrame) -> DataFrame:
    """rows (doc_id, sent_id, uid, problem): nodes whose parent is missing, and roots beyond the first."""
    up = tree.select(*_SENT, F.col("uid").alias("parent_uid"), F.lit(1).alias("_u"))
    lost = tree.where("parent_uid IS NOT NULL").join(up, [*_SENT, "parent_uid"], "left").where("_u IS NULL").select(*_SENT, "uid", F.lit("parent missing").alias("problem"))
    roots = tree.where("parent_uid IS NULL").withColumn("_r", F.row_number().over(W.partitionBy(*_SENT).orderBy("uid"))).where("_r > 1").select(*_SENT, "uid", F.lit("second root").alias("problem"))
    return lost.union(roots)


def empty_words(words: DataFrame) -> DataFrame:
    """words without a text."""
    return words.where("coalesce(text, '') = ''")


def word_nodes(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, uid, level, label, word_id, node_label): a preterminal as `text (TAG/dep)` with its lemma on
    a line of its own where that differs, other nodes as their label."""
    j = tree.join(words.select(*_SENT, "word_id", "text", "lemma", "tag", "dep"), [*_SENT, "word_id"], "left")
    lem = F.when(F.col("lemma").isNotNull() & (F.lower("lemma") != F.lower("text")), F.concat(F.lit("\n"), "lemma")).otherwise("")
    lab = F.when(F.col("word_id").isNotNull(), F.concat("text", F.lit(" ("), F.coalesce("tag", F.lit("")), F.lit("/"), F.coalesce("dep", F.lit("")), F.lit(")"), lem)).otherwise(F.col("label"))
    return j.select(*_SENT, "uid", "level", "label", "word_id", lab.alias("node_label"))


def node_roles(tree: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, uid, role) of preterminals, the first that applies: main_noun, main_verb, main_adjective (the
    sentence's root word), root, subject, head_different_subsentence, noun, verb, adjective."""
    t = tree.where("word_id IS NOT NULL").join(words.select(*_SENT, "word_id", "head_id", "tag", "dep"), [*_SENT, "word_id"])
    head = t.select(*_SENT, F.col("word_id").alias("head_id"), F.col("subsentence_uid").alias("_hs"))
    t = t.join(head, [*_SENT, "head_id"], "left")
    root = F.col("head_id") == 0
    noun, verb, adj = noun_like(F.col("tag"), F.col("dep")), verb_like(F.col("tag"), F.col("dep")), adjective_like(F.col("tag"), F.col("dep"))
    role = (
        F.when(root & noun, "main_noun").when(root & verb, "main_verb").when(root & adj, "main_adjective").when(root, "root").when(F.col("dep").isin(*SUBJECTS), "subject")
        .when(F.col("_hs") != F.col("subsentence_uid"), "head_different_subsentence").when(noun, "noun").when(verb, "verb").when(adj, "adjective")
    )
    return t.select(*_SENT, "uid", role.alias("role")).where("role IS NOT NULL")


def tree_edges(tree: DataFrame) -> DataFrame:
    """(doc_id, sent_id, src, dst, kind): parents to children that are clauses, phrases or preterminals."""
    t = tree.where("parent_uid IS NOT NULL").where(clause_level(F.col("label")) | phrase_level(F.col("label")) | F.col("word_id").isNotNull())
    return t.select(*_SENT, F.col("parent_uid").alias("src"), F.col("uid").alias("dst"), F.lit("parent").alias("kind"))


def copula_edges(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, src, dst, kind): the subject of a copula's clause to its head."""
    cop = words.where("dep = 'cop'").select(*_SENT, "head_id", F.col("word_id").alias("cop_id"))
    s = words.where(F.col("dep").isin("nsubj", "csubj")).select(*_SENT, "head_id", F.col("word_id").alias("src"))
    return s.join(cop, [*_SENT, "head_id"]).select(*_SENT, "src", F.col("head_id").alias("dst"), F.lit("COPULA relationship").alias("kind"))


def sentence_graph(words: DataFrame, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sentences: dependency, order, copula, resolution and identical-noun edges, and
    with `tree` those of constituency, whose preterminals are the words themselves. Each (src, dst, extra) once,
    the last kind in order kept; nodes are the ends of edges."""
    at = lambda c: _uid(F.col("sent_id"), F.col(c))
    cop = copula_edges(words).select("doc_id", at("src").alias("src"), at("dst").alias("dst"), "kind", F.lit("copula").alias("extra"))
    res = relative_resolutions(words).select("doc_id", at("word_id").alias("src"), at("target").alias("dst"), F.col("version").alias("kind"), F.lit("resolution").alias("extra"))
    e = dependency_edges(words).unionByName(word_order_edges(words)).unionByName(identical_noun_edges(words)).unionByName(cop).unionByName(res)
    if tree is not None:
        word = tree.where("word_id IS NOT NULL").select(*_SENT, "uid", at("word_id").alias("_w"))
        t = tree_edges(tree).join(word.withColumnRenamed("uid", "dst"), [*_SENT, "dst"], "left")
        e = e.unionByName(t.select("doc_id", "src", F.coalesce("_w", "dst").alias("dst"), "kind", F.lit("constituency").alias("extra")))
    e = e.groupBy("doc_id", "src", "dst", "extra").agg(F.max("kind").alias("kind"))
    n = e.select("doc_id", F.col("src").alias("uid")).union(e.select("doc_id", F.col("dst").alias("uid"))).distinct()
    return n, e


# Styles of edges, the first that applies.
EDGE_STYLES = (("COPULA relationship", "color=red"), ("dependency", "color=blue"), ("order", "color=gray style=dotted"), ("noun", "color=green dir=none"), ("constituency", "color=black"), ("resolution", "color=purple"), ("coref", "color=orange dir=none"))


def dot_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K6: (doc_id, dot): each document's graph in the DOT language; styles by kind, then class of edge."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    style = F.lit("")
    for name, s in reversed(EDGE_STYLES):
        style = F.when((F.col("kind") == name) | (F.col("extra") == name), F.lit(" " + s)).otherwise(style)
    lines = edges.select("doc_id", F.concat(quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("kind")), style, F.lit("];")).alias("l"))
    lines = lines.union(nodes.select("doc_id", F.concat(quote(F.col("uid")), F.lit(";"))))
    return lines.groupBy("doc_id").agg(F.concat(F.lit("digraph {\n"), F.array_join(F.sort_array(F.collect_list("l")), "\n"), F.lit("\n}")).alias("dot"))
