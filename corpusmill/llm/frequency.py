"""Occurrences and record counts of every term, from a vertical layout of compressed bitmaps.

Each term has containers, one per run of 65,536 record ids: sorted 16-bit ids while few, a bit set of
8 KB beyond, whichever is smaller. Tasks build the containers of their own rows with a counter of
occurrences beside each; containers are merged by union and counters by addition; a term's record count
is the sum of the cardinalities of its containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusmill.llm.records import COUNTING_SQL, counting_rows
from corpusmill.plans.lineage import written

_ARRAY_MOST = 4096  # ids in an array container: 2 bytes each, as large as the bit set
#: Rows a task packs at once.
PACKED_ROWS = 500_000


def pack(low: np.ndarray) -> bytes:
    """Container of the 16-bit ids `low`: b'a' and the sorted ids, or b'b' and the bit set."""
    low = np.asarray(low, dtype=np.int64)
    if len(low) > 1:
        low = np.unique(low)
    if len(low) <= _ARRAY_MOST:
        return b"a" + low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpack(box: bytes) -> np.ndarray:
    body = np.frombuffer(box, np.uint8, offset=1)
    return body.view("<u2").astype(np.int64) if box[:1] == b"a" else np.flatnonzero(np.unpackbits(body))


def union(a: bytes, b: bytes) -> bytes:
    """Container of the ids of either."""
    if a[:1] == b[:1] == b"b":
        return b"b" + (np.frombuffer(a, np.uint8, offset=1) | np.frombuffer(b, np.uint8, offset=1)).tobytes()
    return pack(np.concatenate([unpack(a), unpack(b)]))


def cardinality(box: bytes) -> int:
    return (len(box) - 1) // 2 if box[:1] == b"a" else int(np.bitwise_count(np.frombuffer(box, np.uint8, offset=1)).sum())


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted columns, and the end."""
    n = len(columns[0])
    new = np.zeros(max(n, 1), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new[:n]), n]


def _containers(table: pa.Table) -> pa.RecordBatch:
    """One container per value and chunk of the rows (term, record, cnt)."""
    coded = table.column("term").combine_chunks().dictionary_encode()
    code, record, count = coded.indices.to_numpy(), table.column("record").to_numpy(), table.column("cnt").to_numpy()
    order = np.lexsort((record, code))
    code, record, count = code[order], record[order], count[order]
    chunk, low = record >> 16, record & 65535
    cut = _groups(code, chunk)
    box = [pack(low[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
    total = np.add.reduceat(count, cut[:-1])
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[cut[:-1]])), pa.array(chunk[cut[:-1]]), pa.array(box, pa.binary()), pa.array(total)], schema=_BOXES)


def _built(batches):
    """Containers of a task's rows, handed on every PACKED_ROWS rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACKED_ROWS:
            yield _containers(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _containers(pa.Table.from_batches(held))


def _merged(batches):
    """Containers of one value and chunk, which follow each other, as their union, their counters added up.
    No more than one container is held beside the batch."""
    last = None  # term, chunk, box, occurrences
    for b in batches:
        term, chunk = b.column("term").to_pylist(), b.column("chunk").to_pylist()
        box, count = b.column("box").to_pylist(), b.column("occurrences").to_pylist()
        out: list[tuple] = []
        for t, c, x, n in zip(term, chunk, box, count):
            if last is not None and last[0] == t and last[1] == c:
                last = (t, c, union(last[2], x), last[3] + n)
            else:
                if last is not None:
                    out.append(last)
                last = (t, c, x, n)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _BOXES)], schema=_BOXES)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _BOXES)], schema=_BOXES)


_BOXES = pa.schema([("term", pa.string()), ("chunk", pa.int64()), ("box", pa.binary()), ("occurrences", pa.int64())])
_BOXES_DDL = "term string, chunk long, box binary, occurrences long"


def term_bitmaps(rows: DataFrame, key: str = "term", record: str = "node_id", count: str = "cnt") -> DataFrame:
    """(term, chunk, box, occurrences): the containers of each value of `key`, and its occurrences in them.

    Every task packs containers of its own rows; the containers, not the ids, are shuffled and merged by
    union. A container never holds more than 65,536 ids, so a term of any frequency is spread over as many
    rows as it has chunks. Rows with a null value, record or count are left out; a repeated record counts once."""
    r = rows.select(F.col(key).cast("string").alias("term"), F.col(record).cast("long").alias("record"), F.col(count).cast("long").alias("cnt")).dropna()
    parts = r.mapInArrow(_built, _BOXES_DDL)
    return parts.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_merged, _BOXES_DDL)


@F.pandas_udf(LongType())
def _cardinalities(box: pd.Series) -> pd.Series:
    return box.map(cardinality)


def term_frequencies(rec: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, ate_count, nodes, mark) of every term of the rows that count.

    mark is `rare` for terms in at most `rare` nodes, `common` in at least `common` of all nodes that
    have rows that count, `rare,common` for both, null for neither. No rows in, no rows out.
    The record count of a term is the cardinality of its containers. The number of nodes is read from
    containers of all nodes, the same way.
    """
    rows = written(counting_rows(rec), "rows")
    boxes = term_bitmaps(rows)
    every = term_bitmaps(rows.select(F.lit("").alias("term"), "node_id", "cnt")).agg(F.sum(_cardinalities("box")).alias("all_nodes"))
    out = boxes.groupBy("term").agg(F.sum("occurrences").alias("ate_count"), F.sum(_cardinalities("box")).alias("nodes")).crossJoin(F.broadcast(every))
    marks = F.array_join(F.array_compact(F.array(F.when(F.col("nodes") <= rare, "rare"), F.when(F.col("nodes") >= F.col("all_nodes") * common, "common"))), ",")
    return out.select("term", "ate_count", "nodes", F.when(marks != "", marks).alias("mark"))


def marked(rec: DataFrame) -> DataFrame:
    """(term, mark): one row per term and mark."""
    return term_frequencies(rec).where("mark IS NOT NULL").select("term", F.explode(F.split("mark", ",")).alias("mark"))


_COUNTED = f"""WITH {COUNTING_SQL},
f AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS ate_count, count(DISTINCT node_id) AS nodes, (SELECT count(DISTINCT node_id) FROM rows_) AS every FROM rows_ GROUP BY term)
"""

SQL = {
    "p6_frequencies": _COUNTED + """
SELECT term, ate_count, nodes, CASE WHEN nodes <= 2 AND nodes * 5 >= every THEN 'rare,common' WHEN nodes <= 2 THEN 'rare' WHEN nodes * 5 >= every THEN 'common' END AS mark FROM f""",
    "p6_found": _COUNTED + """
SELECT term, 'rare' AS mark FROM f WHERE nodes <= 2 UNION ALL SELECT term, 'common' AS mark FROM f WHERE nodes * 5 >= every""",
}

QUERIES = {
    "p6_frequencies": lambda spark, d: term_frequencies(spark.read.parquet(f"{d}/attribute_rec.parquet")),
    "p6_found": lambda spark, d: marked(spark.read.parquet(f"{d}/attribute_rec.parquet")),
}
