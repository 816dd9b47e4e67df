"""Units of documents that ask questions of the whole corpus.

Several operators must know, for very many small keys of a text (windows, words,
n-grams), what the rest of the corpus has.  Moving one row per key would cost more
than the text itself.  So documents are grouped into *units* of a few MB by hash; a
unit sends every key range (*bucket*) one packed list of its distinct keys; the
bucket, which sees the lists of all units, answers each list; and the unit, with its
texts at hand again, reads the answers.  A frequent key costs one entry per unit.

All rounds of an operator form one plan in which the exchange of the texts is
the same for every round, so Spark shuffles the texts once.  Nothing is kept outside
Spark's shuffles, and a lost executor's part is computed again from the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_BYTES = 4 << 20
MOST_BUCKETS = 4096

LISTS = "unit int, bucket int, keys binary, notes binary"


class Layout:
    """Number of units and buckets for a corpus; both grow with it."""

    def __init__(self, docs: DataFrame, text: str, unit_bytes: int = UNIT_BYTES):
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.units = max(1, -(-total // unit_bytes))
        self.bits = min(12, max(4, (self.units // 4).bit_length()))
        self.buckets = 1 << self.bits


def by_unit(docs: DataFrame, layout: Layout, id_column: str, text: str, *more: str) -> DataFrame:
    """``unit``, ``id``, ``text`` and further columns; the same plan each time."""
    unit = F.pmod(F.xxhash64(F.col(id_column), F.col(text)), F.lit(layout.units)).cast("int")
    return docs.select(unit.alias("unit"), F.col(id_column).alias("id"), F.col(text).alias("text"), *more)


def send(docs: DataFrame, work: Callable[[pa.Table], Iterator[tuple[int, bytes, bytes]]]) -> DataFrame:
    """First round: ``work`` turns a unit's documents into (bucket, keys, notes)."""

    def kernel(key, table):
        return _lists(int(key[0].as_py()), work(table))

    return docs.groupBy("unit").applyInArrow(kernel, LISTS)


def answer(lists: DataFrame, work: Callable[[list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """A bucket answers: ``work`` gets the keys and notes of all lists and returns one
    reply for each."""

    def kernel(table):
        table = table.combine_chunks()
        keys, notes = ([v.as_py() for v in table.column(c)] for c in ("keys", "notes"))
        replies = work(keys, notes)
        return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"),
                         "keys": pa.array(replies, pa.binary()), "notes": pa.nulls(len(replies), pa.binary())})

    return lists.groupBy("bucket").applyInArrow(kernel, LISTS)


def send_again(docs: DataFrame, replies: DataFrame, work: Callable[[pa.Table, list[bytes]], Iterator[tuple[int, bytes, bytes]]]) -> DataFrame:
    """A further round: like ``send``, with the unit's replies in bucket order."""

    def kernel(key, table, back):
        if table.num_rows == 0:
            return _lists(0, iter(()))
        return _lists(int(key[0].as_py()), work(table, _ordered(back)))

    return docs.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(kernel, LISTS)


def finish(docs: DataFrame, replies: DataFrame, work: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Last round: ``work`` turns a unit's documents and replies into result rows."""

    def kernel(table, back):
        return work(table, _ordered(back))

    return docs.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(kernel, schema)


def _ordered(back: pa.Table) -> list[bytes]:
    pairs = sorted(zip(back.column("bucket").to_pylist(), (v.as_py() for v in back.column("keys"))), key=lambda p: p[0])
    return [p[1] for p in pairs]


def _lists(unit: int, rows: Iterator[tuple[int, bytes, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"unit": pa.array([unit] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                     "keys": pa.array([r[1] for r in rows], pa.binary()), "notes": pa.array([r[2] for r in rows], pa.binary())})


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the buckets in sorted 64-bit keys; a bucket is the top ``bits`` bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, which compresses better in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
