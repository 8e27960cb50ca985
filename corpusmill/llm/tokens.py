"""Encoding texts with a public byte-level BPE tokenizer by merge replay.

The distinct words of a batch of documents are encoded together: an inverted index leads from each
pair of adjacent tokens to the positions where it stands, and the merges are applied in the order of
their ranks, each at all its positions at once, updating only the pairs next to them. A worker keeps
the words it has encoded, so common words are replayed once a worker, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the pattern that divides text into words is published with them.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker keeps; beyond, it starts afresh (which costs time, not results).
KEPT_WORDS = 400_000


class Replay:
    """Encodes words by replaying the merges of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict = {}
        self.words: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall

    def rank(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return got

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, all words at once."""
        sym, nxt, prv, head = [], [], [], []
        for w in words:
            ids = [self.single[x] for x in w.encode("utf-8", "surrogatepass")]
            s, n = len(sym), len(ids)
            head.append(s if n else -1)
            sym += ids
            nxt += [*range(s + 1, s + n), -1][:n]
            prv += [-1, *range(s, s + n - 1)][:n]
        where, order, rank = defaultdict(list), [], self.rank
        for p, q in enumerate(nxt):
            if q >= 0 and (r := rank(sym[p], sym[q])) >= 0:
                where[r].append(p)
        order = list(where)
        heapq.heapify(order)
        while order:
            r = heapq.heappop(order)
            at = where.pop(r, None)
            if at is None:
                continue
            at.sort()  # the leftmost first where pairs overlap
            for p in at:
                q = nxt[p] if sym[p] >= 0 else -1
                if q < 0 or rank(sym[p], sym[q]) != r:
                    continue
                sym[p], sym[q] = r, -1
                n = nxt[p] = nxt[q]
                if n >= 0:
                    prv[n] = p
                    if (k := rank(r, sym[n])) >= 0:
                        if k not in where:
                            heapq.heappush(order, k)
                        where[k].append(p)
                b = prv[p]
                if b >= 0 and (k := rank(sym[b], r)) >= 0:
                    if k not in where:
                        heapq.heappush(order, k)
                    where[k].append(b)
        out = []
        for s in head:
            ids = []
            while s >= 0:
                ids.append(sym[s])
                s = nxt[s]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of int32; none for a null or empty text."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        new = list({w for ws in split for w in ws}.difference(self.words))
        for w, ids in zip(new, self.encode_words(new)):
            self.words[w] = np.array(ids, np.int32).tobytes()
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def replay(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Replay:
    return Replay(f"{folder}/{vocabulary}")


def _slices(batch: pa.RecordBatch, column: str, most: int = 1000):
    for s in range(0, batch.num_rows, most):
        part = batch.slice(s, most)
        yield part, part.column(column).to_pylist()


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): token ids of every row's text, without special tokens; strings that look like special
    tokens are ordinary text. A null and an empty text have an empty list. Repeated rows stay repeated;
    other columns are ignored. Texts of any length are encoded whole."""

    def run(batches):
        bpe = replay(folder, vocabulary)
        for batch in batches:
            for part, texts in _slices(batch, "_t"):
                ids = bpe.encode(texts)
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column("_k"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["_k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, f"_k {kind}, ids array<int>").select(F.col("_k").alias(key), "ids")


def counted(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns of `docs`, and `tokens`, the number of tokens of its text (0 for null)."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        bpe = replay(folder, vocabulary)
        for batch in batches:
            for part, texts in _slices(batch, text):
                n = pa.array([len(x) // 4 for x in bpe.encode(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], n], [*rest, "tokens"])

    return docs.select(*rest, text).mapInArrow(run, schema + ", tokens long")


SQL: dict = {}
QUERIES = {"p7_ids": lambda spark, d: encoded(spark.read.parquet(f"{d}/documents.parquet"))}
