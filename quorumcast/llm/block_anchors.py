"""Substring deduplication on words with fixed-block anchors.

A repeat of 13 words holds, wherever it lies, one whole block of 7 words that
starts at a multiple of 7 in its document.  So the reference side indexes only those
non-overlapping blocks; the probing side looks up every rolling 7-word window.
A window whose probe hits a block, of another document or one's own that others
probe, is an anchor.  Anchors are extended to all 13-word windows around them, and
the extension is verified across documents by the windows' own hash: overlapping
verified windows make up the maximal repeats.

Round 1 sends distinct probes with block marks (32 bits below the bucket's own
bits, enough to rule out; a false hit only costs an extension) and gets one bit back
for each.  Round 2 sends the hash of each window at an anchor with the unit's smallest
document id and gets back whether a smaller one exists.  The last round removes.

Equality of windows is decided by 64-bit hash.

Defined cases: NULL and empty texts have no words; fewer words than a window have no
window; of repeated rows with the same id none removes the other, as the id is
not smaller; NULL ids are not supported; empty tables give empty results.  Only the
named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quorumcast.llm import text_arrays as ta
from quorumcast.llm import units

WINDOW = 13
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class _Unit:
    """Hashed words of a unit's documents and the hashes of their probes."""

    def __init__(self, table: pa.Table, width: int):
        self.block = (width + 1) // 2
        # A NULL id is larger than any.
        self.ids = pc.fill_null(table.column("id"), np.iinfo(np.int64).max).to_numpy()
        self.data, offsets = ta.flat(table.column("text"))
        self.starts, self.ends, self.rows = ta.words(self.data, offsets, ta.PLAIN)
        self.hashes = ta.word_hashes(self.data, self.starts, self.ends)
        self.row = ta.row_of(self.rows)
        self.width = width

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of windows of ``k`` words inside one document."""
        h = ta.window_hashes(self.hashes, k)
        at = np.flatnonzero(self.row[:len(h)] == self.row[k - 1:k - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the sorting order, and the number of the value at each
    place of that order."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new], order, np.cumsum(new) - 1


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _probes(u: _Unit, bits: int):
    at, h = u.windows(u.block)
    distinct, order, number = _distinct(h)
    # Windows that differ only below the bits sent are one key.
    low = np.concatenate([[True], (distinct[1:] >> np.uint64(32 - bits)) != (distinct[:-1] >> np.uint64(32 - bits))]) if len(distinct) else np.zeros(0, bool)
    key = np.cumsum(low) - 1
    number = key[number] if len(number) else number
    return at, order, number, distinct[low]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WINDOW,
                   unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """Per document the words left after removing each word covered by a window of
    ``width`` words that also starts in a document with a smaller id: ``doc_id``,
    ``n_words``, ``n_removed`` and the hash of the kept words, joined by one space."""
    layout = units.Layout(docs, text, unit_bytes)
    bits, buckets = layout.bits, layout.buckets
    rows = units.by_unit(docs.withColumn(id_column, docs[id_column].cast("bigint")), layout, id_column, text)

    def first(table):
        u = _Unit(table, width)
        at, order, number, keys = _probes(u, bits)
        row = u.row[at]
        is_block = np.zeros(len(keys), bool)
        is_block[number[((at - u.rows[row]) % u.block == 0)[order]]] = True
        lowest, highest = np.full(len(keys), len(u.ids)), np.zeros(len(keys), np.int64)
        np.minimum.at(lowest, number, row[order])
        np.maximum.at(highest, number, row[order])
        cut = units.cuts(keys, bits)
        for b in range(buckets):
            s = slice(cut[b], cut[b + 1])
            yield b, units.pack(_low(keys[s], bits)), units.pack_bits(np.concatenate([is_block[s], (highest > lowest)[s]]))

    def meet(keys, notes):
        lists = [units.unpack(k, np.uint32) for k in keys]
        marks = [units.unpack_bits(n, 2 * len(x)) for n, x in zip(notes, lists)]
        values = np.concatenate(lists)
        if len(values) == 0:
            return [b""] * len(lists)
        is_block = np.concatenate([m[:len(x)] for m, x in zip(marks, lists)])
        several = np.concatenate([m[len(x):] for m, x in zip(marks, lists)])
        distinct, order, number = _distinct(values)
        times = np.bincount(number, 1 + several[order], len(distinct))
        anchored = np.bincount(number, is_block[order], len(distinct))
        hit = np.zeros(len(values), bool)
        hit[order] = ((times > 1) & (anchored > 0))[number]
        ends = np.cumsum([len(x) for x in lists])
        return [units.pack_bits(hit[e - len(x):e]) for x, e in zip(lists, ends)]

    def anchored_windows(u, hits):
        """Windows around anchors: positions, sort order, number of the value, values."""
        at, order, number, keys = _probes(u, bits)
        cut = units.cuts(keys, bits)
        hit = np.concatenate([units.unpack_bits(h, cut[b + 1] - cut[b]) for b, h in enumerate(hits)]) if hits else np.zeros(0, bool)
        near = np.zeros(len(u.hashes) + 1, np.int64)
        place = at[order][hit[number]] if len(number) else np.zeros(0, np.int64)
        np.add.at(near, np.maximum(0, place - (u.width - u.block)), 1)
        np.add.at(near, place + 1, -1)
        near = np.cumsum(near)[:-1] > 0
        start, h = u.windows(u.width)
        take = near[start]
        start, h = start[take], h[take]
        values, order, number = _distinct(h)
        least = np.full(len(values), np.iinfo(np.int64).max)
        ids = u.ids[u.row[start]][order]
        np.minimum.at(least, number, ids)
        return start, order, number, values, least, ids

    def second(table, hits):
        u = _Unit(table, width)
        _, _, _, values, least, _ = anchored_windows(u, hits)
        cut = units.cuts(values, bits)
        for b in range(buckets):
            s = slice(cut[b], cut[b + 1])
            yield b, units.pack(values[s]), len(hits[b]).to_bytes(4, "little") + hits[b] + units.pack(least[s])

    def compare(keys, notes):
        lists = [units.unpack(k, np.uint64) for k in keys]
        carried, owners = [], []
        for n in notes:
            size = int.from_bytes(n[:4], "little")
            carried.append(n[:4 + size])
            owners.append(units.unpack(n[4 + size:], np.int64))
        values, least = np.concatenate(lists), np.concatenate(owners)
        distinct, order, number = _distinct(values)
        lowest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(lowest, number, least[order])
        before = np.zeros(len(values), bool)
        before[order] = lowest[number] < least[order]
        ends = np.cumsum([len(x) for x in lists])
        return [c + units.pack_bits(before[e - len(x):e]) for c, x, e in zip(carried, lists, ends)]

    def remove(table, replies):
        u = _Unit(table, width)
        hits, before = [], []
        for r in replies:
            size = int.from_bytes(r[:4], "little")
            hits.append(r[4:4 + size])
            before.append(r[4 + size:])
        start, order, number, values, least, ids = anchored_windows(u, hits)
        cut = units.cuts(values, bits)
        earlier = np.concatenate([units.unpack_bits(x, cut[b + 1] - cut[b]) for b, x in enumerate(before)]) if before else np.zeros(0, bool)
        gone = start[order][earlier[number] | (ids > least[number])] if len(number) else start
        cover = np.zeros(len(u.hashes) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + width, -1)
        removed = np.cumsum(cover)[:-1] > 0
        digests = []
        for r in range(len(u.ids)):
            s = slice(u.rows[r], u.rows[r + 1])
            keep = ~removed[s]
            digest = hashlib.sha256()
            a, b = u.starts[s][keep], u.ends[s][keep]
            if len(a):
                digest.update(_joined(u.data, a, b))
            digests.append(digest.hexdigest())
        return pa.table({"doc_id": table.column("id").cast(pa.int64()), "n_words": pa.array(np.diff(u.rows), pa.int64()),
                         "n_removed": pa.array(ta.sums(removed, u.rows), pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    lists = units.answer(units.send(rows, first), meet)
    lists = units.answer(units.send_again(rows, lists, second), compare)
    return units.finish(rows, lists, remove, RESULT)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space: a copy of each word and the byte after it."""
    lo, hi = int(starts[0]), int(ends[-1])
    piece = np.empty(hi - lo + 1, np.uint8)
    piece[:-1] = data[lo:hi]
    piece[ends - lo] = 32
    change = np.zeros(hi - lo + 2, np.int8)
    change[starts - lo] += 1
    change[ends - lo + 1] -= 1
    return piece[np.cumsum(change[:-1], dtype=np.int8) > 0][:-1].tobytes()
