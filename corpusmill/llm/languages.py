"""Language of each document and of each stretch of it, whatever its label says.

A bidirectional gated recurrent network over bytes, trained here by backpropagation through time,
labels every position of a word; positions are pooled to words, words to sentences, sentences to
stretches and documents.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.lookalikes import _LATIN_LIKE, _LIKE, prototype, script
from corpusmill.llm.scans import _wrapped, furniture

LANGS = ("en", "de", "fr", "es", "it", "pt", "ru")
#: Labelled documents the network is trained on, at most, chosen by a hash of doc_id; the counts of
#: words in them are all that reaches the driver.
TRAIN_DOCS = 6000
#: Distinct words used, those of most documents first, and the documents a word must be in.
TRAIN_WORDS, LEAST_DOCS = 8000, 4
#: Words of fewer documents, mostly names, that are trained to speak for no language, at most.
TRAIN_NAMES = 3000
HIDDEN, EMBED, EPOCHS, BATCH = 24, 12, 50, 64
#: Log-odds by which a sentence must speak for another language than its document's, and the least
#: number of words of such a sentence.
MARGIN, LEAST_WORDS = 3.0, 3
#: Words a worker keeps; beyond, it starts afresh.
KEPT_WORDS = 400_000


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """Weights of the network: byte embeddings, a gated recurrent layer each way, a softmax layer."""

    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": r(256, EMBED) * 4, "out": r(2 * HIDDEN, len(LANGS)), "bo": np.zeros(len(LANGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": r(EMBED, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"c{d}": np.zeros(HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction over byte rows x (n, t), in the order of the bytes."""
        p, (n, t) = self.p, x.shape
        pre = p["emb"][x] @ p[f"W{d}"] + p[f"b{d}"]
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            u = h @ p[f"U{d}"]
            z, r = _sigmoid(pre[:, i, :HIDDEN] + u[:, :HIDDEN]), _sigmoid(pre[:, i, HIDDEN : 2 * HIDDEN] + u[:, HIDDEN : 2 * HIDDEN])
            v = u[:, 2 * HIDDEN :] + p[f"c{d}"]
            m = np.tanh(pre[:, i, 2 * HIDDEN :] + r * v)
            if keep is not None:
                keep.append((i, h, z, r, v, m))
            h = (1 - z) * m + z * h
            out[:, i] = h
        return out

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (n, t, languages) of each position of byte rows of one length."""
        kf, kb = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._run(x, "f", kf), self._run(x, "b", kb)], axis=2)
        a = s @ self.p["out"] + self.p["bo"]
        a = np.exp(a - a.max(2, keepdims=True))
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s}
        return a / a.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss, and gradients by backpropagation through time; every position has its word's target."""
        keep: dict = {}
        y = self.positions(x, keep)
        (n, t), x_type = x.shape, self.p["out"].dtype
        w = (weight / weight.sum() / t)[:, None, None].astype(np.float32)
        loss = float(-(w * target[:, None] * np.log(y + 1e-9)).sum())
        da = (y - target[:, None]) * w
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = lambda a: a.reshape(n * t, -1)
        g["out"] = flat(keep["s"]).T @ flat(da)
        g["bo"] = da.sum((0, 1))
        ds = da @ self.p["out"].T
        for k, d in enumerate("fb"):
            dpre, dh = np.empty((n, t, 3 * HIDDEN), x_type), np.zeros((n, HIDDEN), x_type)
            back = np.ascontiguousarray(self.p[f"U{d}"].T)
            for i, h, z, r, v, m in reversed(keep[d]):
                dh = dh + ds[:, i, k * HIDDEN : (k + 1) * HIDDEN]
                dm = dh * (1 - z) * (1 - m * m)
                dz, dr, dv = dh * (h - m) * z * (1 - z), dm * v * r * (1 - r), dm * r
                dpre[:, i] = np.concatenate([dz, dr, dm], axis=1)
                du = np.concatenate([dz, dr, dv], axis=1)
                g[f"U{d}"] += h.T @ du
                g[f"c{d}"] += dv.sum(0)
                dh = dh * z + du @ back
            g[f"W{d}"] = flat(self.p["emb"][x]).T @ flat(dpre)
            g[f"b{d}"] = dpre.sum((0, 1))
            g["emb"] += np.eye(256, dtype=np.float32)[x.ravel()].T @ flat(dpre @ self.p[f"W{d}"].T)
        return loss, g

    def train(self, words: list[str], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> list[float]:
        """Adam over batches of words of one length in bytes. The mean loss of each epoch."""
        rng, by = np.random.default_rng(seed), {}
        for i, w in enumerate(words):
            by.setdefault(len(_bytes(w)), []).append(i)
        rows = {n: (np.array(ix), np.array([list(_bytes(words[i])) for i in ix], np.int64)) for n, ix in by.items()}
        m, s, step, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, []
        for epoch in range(epochs):
            batches = []
            for n, (ix, _) in rows.items():
                o = rng.permutation(len(ix))
                batches += [(n, o[k : k + BATCH]) for k in range(0, len(o), BATCH)]
            total, rate = 0.0, 0.012 * (0.5 * (1 + np.cos(np.pi * epoch / epochs))) + 2e-4
            for b in rng.permutation(len(batches)):
                n, o = batches[b]
                ix, x = rows[n]
                loss, g = self.gradients(x[o], target[ix[o]], weight[ix[o]])
                total, step = total + loss, step + 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            losses.append(total / len(batches))
        return losses

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of each word, its positions pooled."""
        out, by = np.zeros((len(words), len(LANGS)), np.float32), {}
        for i, w in enumerate(words):
            by.setdefault(len(_bytes(w)), []).append(i)
        for n, ix in by.items():
            for k in range(0, len(ix), 4096):
                part = ix[k : k + 4096]
                x = np.frombuffer(b"".join(_bytes(words[i]) for i in part), np.uint8).reshape(len(part), n)
                out[part] = np.log(self.positions(x).mean(1) + 1e-3)
        return out


def _bytes(word: str) -> bytes:
    """Bytes of a word between spaces."""
    return b" " + word.encode("utf-8", "replace") + b" "


_TO_CYRILLIC = {v: k for k, v in _LIKE.items() if v in _LATIN_LIKE and "А" <= k <= "я"}


def plain_word(word: str) -> str:
    """Lower case, composed, look-alike letters put back into the script of most letters."""
    if word.isascii():
        return word
    cyr = sum(script(c) == "CYRILLIC" for c in word)
    if cyr * 2 <= len(word):
        word = "".join(map(prototype, word))
    else:
        word = "".join(_TO_CYRILLIC.get(c, c) for c in word)
    return unicodedata.normalize("NFC", word).lower()


_HIDDEN_CHARS = regex.compile(r"\p{Cf}+")
_ODD = regex.compile(r"[\p{Cf}̀-ͯ＀-￯ﬀ-ﬆ]")
_WRAP = re.compile(r"(\w)[-¬=\xad][ \t]*\r?\n\s*(?=\w)")
#: A sentence ends at its mark and the quotes after it if a capital, a number or an opening sign follows, or at
#: an empty line, a heading or the start of an item.
_END = regex.compile(r"[.!?…][\"»”’')\]]*(\s+)(?=[\"«“‘¿¡(\[*=]*[\p{Lu}\d])|(\n\s*\n)|(\n)(?=\s*(?:==|\*|#))|==(\s*\n)")
#: Letters in a row; those of more than 40 are read in pieces.
_WORD = regex.compile(r"[^\W\d_]{1,40}")
def _whole(text: str, start: int, end: int) -> bool:
    """Whether a stretch begins with no small letter and ends with a sentence's mark."""
    if text[max(start, end - 8) : end].rstrip().rstrip("\"»”’')] ")[-1:] not in (".", "!", "?", "…"):
        return False
    return next((not c.islower() for c in text[start : min(end, start + 40)] if c.isalnum()), False)


_PAGED = regex.compile(r"\f|^[^\p{L}\n]{0,6}\d+[^\p{L}\n]{0,6}$|^\p{L}+\.? \d+ \p{L}+ \d+\s*$", regex.M)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a cleaned text."""
    out, at = [], 0
    for m in _END.finditer(text):
        stop = m.start(m.lastindex)
        if stop > at:
            out.append((at, stop))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def cleaned(text: str) -> str:
    """Without invisible characters and page furniture; compatibility forms, separate accents and line wraps undone."""
    if not text.isascii() and _ODD.search(text):
        text = unicodedata.normalize("NFKC", _HIDDEN_CHARS.sub("", text))
    if "\n" not in text:
        return text
    if _PAGED.search(text):
        lines = text.split("\n")
        if _wrapped(lines):
            drop = furniture(lines)
            text = "\n".join(x for i, x in enumerate(lines) if not drop[i] and (x.strip() or not (i and drop[i - 1])))
    return _WRAP.sub(r"\1", text)


class Labeller:
    """Labels texts with a trained network; keeps the words it has met."""

    def __init__(self, net: ByteGru):
        self.net, self.at, self.table = net, {}, np.zeros((0, len(LANGS)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.at) > KEPT_WORDS:
            self.at, self.table = {}, self.table[:0]
        new = list(set(words).difference(self.at))
        if new:
            plain = [plain_word(w) for w in new]
            once = {w: i for i, w in enumerate(dict.fromkeys(plain))}
            got = self.net.words(list(once))
            self.table = np.concatenate([self.table, got[[once[w] for w in plain]]])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        get = self.at.__getitem__
        return self.table[np.fromiter(map(get, words), np.int64, len(words))]

    def documents(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its sentences as (start, end, words, language, confidence, whole), over the cleaned text;
        none for a text without words. `whole` is a sentence that ends as one, or a text's only stretch of words."""
        words, spans, doc = [], [], []
        for d, t in enumerate(texts):
            if not t:
                continue
            t = cleaned(t)
            low = t.lower()
            if len(low) != len(t):
                low = t
            for s, e in sentences(t):
                w = _WORD.findall(low, s, e)
                if w:
                    words += w
                    spans.append((s, e, len(w), _whole(t, s, e), sum(map(len, w))))
                    doc.append(d)
        out: list[list[tuple]] = [[] for _ in texts]
        if not words:
            return out
        n = np.array([x[2] for x in spans])
        score = np.add.reduceat(self.scores(words), np.r_[0, np.cumsum(n)[:-1]], axis=0).astype(np.float64)
        doc = np.array(doc)
        total = np.zeros((len(texts), len(LANGS)))
        np.add.at(total, doc, score)
        # the language of most letters: first of sentences by themselves, then by the document's prior
        own = score.argmax(1)
        mass = np.zeros_like(total)
        np.add.at(mass, (doc, own), [x[4] for x in spans])
        main = (mass + 1e-9 * total / np.maximum(1, np.abs(total).max())).argmax(1)
        home = score[np.arange(len(doc)), main[doc]]
        away = (own != main[doc]) & (score.max(1) - home > MARGIN) & (n >= LEAST_WORDS)
        lang = np.where(away, own, main[doc])
        p = np.exp((score - score.max(1, keepdims=True)) / np.sqrt(n)[:, None])
        conf = p[np.arange(len(doc)), lang] / p.sum(1)
        count = np.bincount(doc, minlength=len(texts))
        full = np.zeros(len(texts), int)
        np.add.at(full, doc, [x[3] for x in spans])
        for (s, e, k, whole, _), d, l, c in zip(spans, doc.tolist(), lang.tolist(), conf.tolist()):
            out[d].append((s, e, k, LANGS[l], c, whole or (full[d] == 0 and count[d] >= 1)))
        return out


def label_map(labels: DataFrame) -> dict[str, str]:
    """label -> language, of a table of spellings (a fixed table; more than 10,000 rows are refused)."""
    rows = labels.where("label IS NOT NULL AND lang IS NOT NULL").select("label", "lang").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many labels")
    return {r[0]: r[1] for r in rows}


def _stated(lang: Column, labels: dict[str, str]) -> Column:
    if not labels:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[lang]


def train(docs: DataFrame, labels: dict[str, str]) -> ByteGru:
    """The network, trained on words of at most TRAIN_DOCS labelled documents (a bounded sample by hash).

    A word's target is the share of the languages in its occurrences, each language counting alike,
    squared so that the wrong labels among the documents fade; it weighs as the root of its documents. Without labelled documents the
    network stays untrained."""
    d = docs.select("doc_id", "text", _stated(F.col("lang"), labels).alias("l")).where(F.col("l").isin(*LANGS) & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    last = d.select("h").orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    net = ByteGru()
    if last is None:
        return net
    low = F.regexp_replace(F.lower("text"), r"[-¬]\r?\n", "")
    words = d.where(F.col("h") <= last).select("l", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    got = words.where(F.length("w") <= 30).groupBy("w", "l").count()
    # words of a few documents are mostly names, which say nothing of a language
    each = got.groupBy("w").agg(F.sum("count").alias("n"))
    keep = each.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "w").limit(TRAIN_WORDS)
    names = [r[0] for r in each.where((F.col("n") < LEAST_DOCS) & F.col("w").rlike("^[a-z]{3,10}$")).orderBy(F.xxhash64("w")).limit(TRAIN_NAMES).select("w").collect()]
    pdf = got.join(keep.select("w"), "w").toPandas()
    if not len(pdf):
        return net
    t = pdf.pivot_table(index="w", columns="l", values="count", aggfunc="sum", fill_value=0).reindex(columns=list(LANGS), fill_value=0).sort_index()
    c = t.to_numpy(float)
    rel = (c + 1e-3) / (c.sum(0) + 1.0)
    rel = (rel / rel.sum(1, keepdims=True)) ** 2
    target = np.concatenate([rel / rel.sum(1, keepdims=True), np.full((len(names), len(LANGS)), 1 / len(LANGS))])
    weight = np.concatenate([np.sqrt(c.sum(1)), np.full(len(names), 3.0)])
    net.train(list(t.index) + names, target.astype(np.float32), weight.astype(np.float32))
    return net


_SENT = "doc_id long, start int, end int, words int, lang string, confidence double, whole boolean"


def labelled_sentences(docs: DataFrame, net: ByteGru) -> DataFrame:
    """One row per sentence with words: its span in the cleaned text, words, language, confidence, and
    whether it is a whole one. Null and empty texts, and texts without words, have none."""

    def run(batches):
        lab = Labeller(net)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                p = b.slice(s, 500)
                rows = [(k, *x) for k, d in zip(p.column("doc_id").to_pylist(), lab.documents(p.column("text").to_pylist())) for x in d]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "start", "end", "words", "lang", "confidence", "whole"]).astype({"doc_id": "Int64", "start": "int32", "end": "int32", "words": "int32", "confidence": "float64", "whole": "bool"}), schema=_SCHEMA, preserve_index=False)

    return docs.select("doc_id", "text").mapInArrow(run, _SENT)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("whole", pa.bool_())])


def document_languages(docs: DataFrame, net: ByteGru) -> DataFrame:
    """One row per row of `docs`: doc_id, lang of most of the text, confidence, and stretches: an array of
    (start, end, lang, confidence), one for each run of sentences of one language. A text without words
    has a null lang and confidence and no stretches."""

    def run(batches):
        lab = Labeller(net)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                p = b.slice(s, 500)
                out = []
                for d in lab.documents(p.column("text").to_pylist()):
                    runs: list[list] = []
                    mass: dict[str, float] = {}
                    for a, e, k, lang, c, _ in d:
                        mass[lang] = mass.get(lang, 0) + k
                        if runs and runs[-1][2] == lang:
                            runs[-1][1], runs[-1][3], runs[-1][4] = e, runs[-1][3] + c * k, runs[-1][4] + k
                        else:
                            runs.append([a, e, lang, c * k, k])
                    main = max(mass, key=mass.get) if mass else None
                    conf = sum(r[3] for r in runs if r[2] == main) / sum(mass.values()) if mass else None
                    out.append((main, conf, [{"start": r[0], "end": r[1], "lang": r[2], "confidence": r[3] / r[4]} for r in runs]))
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], _STRETCH)], ["doc_id", "lang", "confidence", "stretches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang string, confidence double, stretches array<struct<start:int,end:int,lang:string,confidence:double>>")


_STRETCH = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def mislabelled(docs: DataFrame, labels: dict[str, str], net: ByteGru) -> DataFrame:
    """(doc_id, lang): the languages of whole sentences of the rows whose label is missing, isn't the
    language of most of the text, or whose text has whole sentences of several languages."""

    def run(batches):
        lab = Labeller(net)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                p = b.slice(s, 500)
                keys, langs = [], []
                for k, said, d in zip(p.column("doc_id").to_pylist(), p.column("lang").to_pylist(), lab.documents(p.column("text").to_pylist())):
                    whole = sorted({x[3] for x in d if x[5]})
                    mass: dict[str, int] = {}
                    for _, _, n, lang, _, _ in d:
                        mass[lang] = mass.get(lang, 0) + n
                    if whole and (labels.get(said) is None or len(whole) > 1 or labels[said] != max(mass, key=mass.get)):
                        keys += [k] * len(whole)
                        langs += whole
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string())], ["doc_id", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string").distinct()


def _read(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), label_map(spark.read.parquet(f"{d}/lang_labels.parquet"))


_NETS: dict = {}


def _net(spark, d: str, docs: DataFrame, labels: dict[str, str]) -> ByteGru:
    """The network trained on the documents of a folder, kept for the next query of the session that asks for it; it is
    trained anew if the table has been written since."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, d, status.getModificationTime(), status.getLen(), tuple(sorted(labels.items())))
    if key not in _NETS:
        _NETS.clear()
        _NETS[key] = train(docs, labels)
    return _NETS[key]


def p9_languages(spark, d):
    docs, labels = _read(spark, d)
    out = document_languages(docs, _net(spark, d, docs, labels))
    return out.select("doc_id", "lang", F.round("confidence", 4).alias("confidence"))


def p9_stretches(spark, d):
    docs, labels = _read(spark, d)
    out = document_languages(docs, _net(spark, d, docs, labels)).select("doc_id", F.posexplode("stretches").alias("stretch_no", "s"))
    return out.select("doc_id", "stretch_no", "s.start", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def p9_found(spark, d):
    docs, labels = _read(spark, d)
    return mislabelled(docs, labels, _net(spark, d, docs, labels))


SQL: dict = {}
QUERIES = {"p9_languages": p9_languages, "p9_stretches": p9_stretches, "p9_found": p9_found}
