"""Exact removal of repeated 200-byte strings with suffix arrays.

Equal strings must meet in one shard before a suffix array can find them.  Every
window of 200 bytes is dealt by the least hash of its 32-byte strings, which depends
on nothing but its content; consecutive windows mostly agree in it, so a text
falls into *contexts*, stretches whose windows share it, and only contexts are sent.

Round 1 sends the key and a hash of each distinct context.  A context whose key nobody
else has holds no repeat.  Contexts equal as a whole are one string with several
copies: all their windows are repeats, and one copy stands for them.  Round 2 sends
the bytes of these and of all other contexts with a shared key to the key's shard.
The shard leaves out windows whose first or last 32 bytes occur once in it, sorts the
suffixes of the rest by induction, computes the permuted common prefixes, and
answers which windows share 200 bytes with a neighbour in suffix order.  The last
round removes.

Memory: a shard sorts a few MB at a time, cut between keys.  The distinct contexts of
one key (the different surroundings of one 32-byte string) are held together.

Defined cases: NULL counts as empty; texts under 200 bytes lose nothing; repeated rows
are separate documents and remove each other; NULL ids are not supported; empty
tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorumcast.llm import text_arrays as ta
from quorumcast.llm import units
from quorumcast.llm.suffix_array import common_prefixes, suffix_array

WIDTH = 200
SEED = 32
SORT_BYTES = 4 << 20
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class _Unit:
    def __init__(self, table: pa.Table, width: int, seed: int):
        self.ids = table.column("id")
        self.data, self.offsets = ta.flat(table.column("text"))
        self.width = width
        self.start, self.count, key, inner = contexts(self.data, self.offsets, width, seed)
        content = ta.word_hashes(self.data, self.start, self.start + self.count + (width - 1))
        order = np.lexsort((content, key))
        k, c = key[order], content[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        #: Distinct contexts, their number of copies here, one copy's place, each copy's number.
        self.keys, self.contents = k[first], c[first]
        self.copies = np.diff(np.append(first, len(k)))
        self.example = order[first]
        self.inner = inner[self.example]
        self.number = np.empty(len(k), np.int64)
        self.number[order] = np.cumsum(new) - 1

    def low(self, bits: int) -> np.ndarray:
        return ((self.keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def contexts(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each context, and whether windows of
    it may be equal to each other.

    Equal windows of one context share it with a window that starts at the least
    string itself and is not the context's last, so the string comes again.
    """
    n = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    least = seeds = seed_hashes(data, seed)
    span, reach = width - seed + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[:reach - span], least[span - reach:])
    long = np.diff(offsets) >= width
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - width + 1, -1)
    inside = np.cumsum(edge)[:n] > 0
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]))
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    again = np.zeros(n, bool)
    again[:-1] = (seeds[:n - 1] == least[:-1]) & inside[:-1] & inside[1:] & ~begins[1:]
    return start, np.add.reduceat(inside.astype(np.int64), start), ta.mix(least[start]), np.logical_or.reduceat(again, start)


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every string of ``seed`` bytes (a power of two), by doubling."""
    h, size, step = ta._TABLE[data], 1, 0x9E3779B97F4A7C15
    while size < seed:
        h = h[:-size] * np.uint64(step) + h[size:]
        step = step * step % (1 << 64)
        size *= 2
    return ta.mix(h)


def repeated_windows(text: np.ndarray, lengths: np.ndarray, groups: np.ndarray, width: int, seed: int,
                     sort_bytes: int = SORT_BYTES) -> np.ndarray:
    """Which bytes of the concatenated contexts start a window that occurs again.

    ``lengths``: of the contexts; ``groups``: their keys.  Windows of different
    groups differ.
    """
    n = len(text)
    found = np.zeros(n, bool)
    if n < width:
        return found
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    h = seed_hashes(text, seed)
    order = np.argsort(h)
    s = h[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= again[1:]
    twice = np.zeros(len(s), bool)
    twice[order] = again
    del h, s, order, again
    window = np.zeros(n, bool)
    window[:n - width + 1] = twice[:n - width + 1] & twice[width - seed:n - seed + 1]
    place = np.arange(n) - np.repeat(offsets[:-1], lengths)
    window &= place + width <= np.repeat(lengths, lengths)
    del place
    lo, hi = ta.runs(window, offsets)
    if len(lo) == 0:
        return found
    group = groups[np.searchsorted(offsets, lo, "right") - 1]
    order = np.argsort(group, kind="stable")
    lo, hi, group = lo[order], hi[order], group[order]
    size = hi - lo + width
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    batch = (np.cumsum(size) - size)[np.maximum.accumulate(np.where(new_group, np.arange(len(lo)), 0))] // sort_bytes
    for b in np.unique(batch):
        mine = np.flatnonzero(batch == b)
        if len(mine) < 2 and hi[mine[0]] - lo[mine[0]] < 2:
            continue
        # Pieces of text, each followed by a separator below all bytes.
        total = int(size[mine].sum())
        first = np.cumsum(size[mine]) - size[mine]
        source = np.repeat(lo[mine] - first, size[mine]) + np.arange(total)
        t = text[np.minimum(source, n - 1)].astype(np.uint16) + 1
        t[first + size[mine] - 1] = 0
        sa = suffix_array(t)
        shared = common_prefixes(t, sa)[sa] >= width
        hit = np.concatenate([sa[shared], sa[np.flatnonzero(shared) - 1]])
        # The tail of a piece starts no window of it; equal tails and separators do not count.
        piece = np.searchsorted(first, hit, "right") - 1
        found[source[hit[hit - first[piece] < hi[mine[piece]] - lo[mine[piece]]]]] = True
    return found


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED,
                   unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """Per document what is left after removing each byte covered by a string of
    ``width`` bytes that also starts elsewhere: sizes, runs removed, hash of the rest."""
    layout = units.Layout(docs, text, unit_bytes)
    bits, buckets = layout.bits, layout.buckets
    rows = units.by_unit(docs.withColumn(id_column, docs[id_column].cast("bigint")), layout, id_column, text)

    def first(table):
        u = _Unit(table, width, seed)
        low, cut = u.low(bits), units.cuts(u.keys, bits)
        for b in range(buckets):
            s = slice(cut[b], cut[b + 1])
            yield b, units.pack(low[s]) + units.pack(u.contents[s]), units.pack_bits(np.concatenate([u.copies[s] > 1, u.inner[s]]))

    def classify(keys, notes):
        """For each context: is it repeated as a whole; are its bytes wanted."""
        sizes = [len(k) // 12 for k in keys]
        key = np.concatenate([units.unpack(k[:4 * n], np.uint32) for k, n in zip(keys, sizes)])
        content = np.concatenate([units.unpack(k[4 * n:], np.uint64) for k, n in zip(keys, sizes)])
        marks = [units.unpack_bits(m, 2 * n) for m, n in zip(notes, sizes)]
        times = 1 + np.concatenate([m[:n] for m, n in zip(marks, sizes)]).astype(np.int64)
        inner = np.concatenate([m[n:] for m, n in zip(marks, sizes)])
        whole, wanted = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if len(key):
            order = np.lexsort((content, key))
            k, c = key[order], content[order]
            new_key = np.concatenate([[True], k[1:] != k[:-1]])
            new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
            at_key, at = np.flatnonzero(new_key), np.flatnonzero(new)
            of_key = np.add.reduceat((times + inner)[order], at_key)[np.cumsum(new_key) - 1]
            of_content = np.add.reduceat(times[order], at)[np.cumsum(new) - 1]
            whole[order] = of_content > 1
            wanted[order] = new & (of_key > 1)
        ends = np.cumsum(sizes)
        return [units.pack_bits(np.concatenate([whole[e - n:e], wanted[e - n:e]])) for n, e in zip(sizes, ends)]

    def classes(u, replies):
        cut = units.cuts(u.keys, bits)
        marks = [units.unpack_bits(r, 2 * (cut[b + 1] - cut[b])) for b, r in enumerate(replies)]
        whole = np.concatenate([m[:len(m) // 2] for m in marks])
        wanted = np.concatenate([m[len(m) // 2:] for m in marks])
        return cut, whole, wanted

    def second(table, replies):
        u = _Unit(table, width, seed)
        cut, whole, wanted = classes(u, replies)
        low = u.low(bits)
        for b in range(buckets):
            mine = np.arange(cut[b], cut[b + 1])[wanted[cut[b]:cut[b + 1]]]
            start = u.start[u.example[mine]]
            length = u.count[u.example[mine]] + (width - 1)
            body = b"".join(u.data[s:s + n].tobytes() for s, n in zip(start.tolist(), length.tolist()))
            head = np.array([len(mine), len(replies[b])], np.int64).tobytes()
            yield b, head + replies[b] + units.pack(length) + units.pack(low[mine]) + units.pack_bits(whole[mine]), body

    def sort(keys, notes):
        lengths, groups, carried, wholes = [], [], [], []
        for k in keys:
            n, size = np.frombuffer(k[:16], np.int64)
            carried.append(k[8:16 + size])
            k = k[16 + size:]
            lengths.append(units.unpack(k[:8 * n], np.int64))
            groups.append(units.unpack(k[8 * n:12 * n], np.uint32))
            wholes.append(units.unpack_bits(k[12 * n:], n))
        text = np.frombuffer(b"".join(notes), np.uint8)
        length, whole = np.concatenate(lengths), np.concatenate(wholes)
        found = repeated_windows(text, length, np.concatenate(groups), width, seed)
        # Answers are wanted for the windows of contexts that are not repeated as a whole.
        place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        asked = np.repeat(~whole, length) & (place + width <= np.repeat(length, length))
        ends = np.cumsum([len(n) for n in notes])
        return [c + units.pack_bits(found[e - len(n):e][asked[e - len(n):e]]) for c, n, e in zip(carried, notes, ends)]

    def remove(table, replies):
        u = _Unit(table, width, seed)
        before, after = [], []
        for r in replies:
            size = int(np.frombuffer(r[:8], np.int64)[0])
            before.append(r[8:8 + size])
            after.append(r[8 + size:])
        change = np.zeros(len(u.data) + 1, np.int64)
        if len(u.start):
            cut, whole, wanted = classes(u, before)
            all_of = whole[u.number]
            np.add.at(change, u.start[all_of], 1)
            np.add.at(change, u.start[all_of] + u.count[all_of] + (width - 1), -1)
            asked = wanted & ~whole
            for b, raw in enumerate(after):
                mine = np.arange(cut[b], cut[b + 1])[asked[cut[b]:cut[b + 1]]]
                if len(mine) == 0:
                    continue
                # Contexts asked about have one copy only, here.
                start, count = u.start[u.example[mine]], u.count[u.example[mine]]
                place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at = place[units.unpack_bits(raw, len(place))]
                change[at] += 1
                change[at + width] -= 1
        removed = np.cumsum(change)[:-1] > 0
        lo, _ = ta.runs(removed, u.offsets)
        spans = np.diff(np.searchsorted(lo, u.offsets))
        digests = []
        for a, z in zip(u.offsets[:-1].tolist(), u.offsets[1:].tolist()):
            digests.append(hashlib.sha256(u.data[a:z][~removed[a:z]].tobytes()).hexdigest())
        return pa.table({"doc_id": u.ids.cast(pa.int64()), "n_bytes": pa.array(np.diff(u.offsets), pa.int64()),
                         "n_removed": pa.array(ta.sums(removed, u.offsets), pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept_sha256": pa.array(digests, pa.string())})

    lists = units.answer(units.send(rows, first), classify)
    lists = units.answer(units.send_again(rows, lists, second), sort)
    return units.finish(rows, lists, remove, RESULT)
