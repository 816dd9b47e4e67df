"""Language-model scoring by prediction by partial matching over bytes.

A text is its token sequence: words in lower case (A-Z), each with a space, and an
end.  The model is a trie of byte contexts of up to ``ORDER`` bytes, with the counts of
the bytes that followed them in the training documents.  A byte is predicted in the
longest context in which it has been seen; from each longer known context the model
escapes first.  Escape estimation is method D (half a count of every distinct
follower goes to the escape), and after an escape the followers of the longer context
are excluded.  Unseen bytes share what is left at the end.  The sum of log10 probabilities is
the document's score, its code length in another unit.

The trie is never gathered.  It is dealt over buckets by the last two bytes of
the context, which keeps every context with all its suffixes of two bytes and more; the
nodes of one and no byte, at most 65,792 counts, go to all buckets.  Units of
documents ask for the distinct strings of context and byte they hold and get each one's
log10 probability.  Word counts for the baseline travel in the same way.

Defined cases: NULL counts as empty; an empty text has one token, the end; with no training documents every byte has probability 1/256; a byte at the
start of a text sees zero bytes before it; empty tables give empty results.  Only the
named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.llm import text_arrays as ta
from quorumcast.llm import units

ORDER = 5
END = 10
_SPREAD = 40503  # odd, so that multiplying modulo 2**16 is one-to-one
_PIECE = 1 << 20
RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token sequences as bytes: each word in lower case and a space, then a line
    feed as the end."""
    n, rows = len(data), len(offsets) - 1
    lower = ta.LOWER[data]
    starts, ends, words = ta.words(lower, offsets, ta.PLAIN)
    # Two bytes to spare after each text, for the last space and the end.
    wide = offsets + 2 * np.arange(rows + 1)
    out = np.full(n + 2 * rows, 32, np.uint8)
    change = np.zeros(len(out) + 2, np.int8)
    shift = 2 * ta.row_of(words)
    change[starts + shift] += 1
    change[ends + shift + 1] -= 1
    inside = np.ones(len(out), bool)
    inside[wide[1:] - 1] = inside[wide[1:] - 2] = False
    out[inside] = np.where(ta.PLAIN[lower], lower, 32)
    keep = np.cumsum(change[:len(out)], dtype=np.int8) > 0
    out[wide[1:] - 1] = END
    keep[wide[1:] - 1] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)[wide[1:] - 1]])


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte of the texts the key of it and its context: the last two bytes of
    the context (spread, so that key ranges are even), the older ones, the byte."""
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    back = []
    for k in range(1, ORDER + 1):
        b = np.zeros(n, np.uint64)
        b[k:] = data[:-k] if n > k else 0
        b[place < k] = 0
        back.append(b)
    key = ((back[1] << np.uint64(8) | back[0]) * np.uint64(_SPREAD)) & np.uint64(0xFFFF)
    for b in back[2:]:
        key = key << np.uint64(8) | b
    return key << np.uint64(8) | data


def _natural(keys: np.ndarray) -> np.ndarray:
    """Oldest context byte first, the predicted byte last."""
    near = ((keys >> np.uint64(8 * (ORDER - 1))) * np.uint64(pow(_SPREAD, -1, 1 << 16))) & np.uint64(0xFFFF)
    out = near << np.uint64(8) | (keys & np.uint64(0xFF))
    for k in range(3, ORDER + 1):
        out |= (keys >> np.uint64(8 * (ORDER - k + 1)) & np.uint64(0xFF)) << np.uint64(8 * k)
    return out


class _Level:
    """One order of the trie: contexts, followers with counts, totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """``keys``: context * 256 + byte, sorted and distinct."""
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts, self.first = context[first], first
        self.total = np.add.reduceat(counts, first) if len(keys) else counts
        self.distinct = np.diff(np.append(first, len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 if absent."""
        if len(self.keys) == 0:
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def context(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's context, -1 if absent."""
        if len(self.contexts) == 0:
            return np.full(len(keys), -1)
        c = keys >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
        return np.where(self.contexts[at] == c, at, -1)


def _shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys (natural byte order, oldest context byte first) with one context byte less."""
    return keys & np.uint64((1 << (8 * order)) - 1)


def _level(keys: np.ndarray, counts: np.ndarray) -> _Level:
    u, back = np.unique(keys, return_inverse=True)
    return _Level(u, np.bincount(back, counts, len(u)).astype(np.int64))


def log_probabilities(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each asked string.

    ``keys`` and ``counts``: the training strings of this part of the trie;
    ``pairs``: 256 x 256 counts of byte after byte, over all training documents.
    """
    order_of = dict(enumerate(range(ORDER, -1, -1)))
    levels: dict[int, _Level] = {ORDER: _level(keys, counts)}
    for k in range(ORDER - 1, 1, -1):
        levels[k] = _level(_shorter(levels[k + 1].keys, k + 1), levels[k + 1].counts)
    flat = np.flatnonzero(pairs.reshape(-1)).astype(np.uint64)
    levels[1] = _Level(flat, pairs.reshape(-1)[flat.astype(np.int64)])
    single = pairs.sum(axis=0)
    byte = np.flatnonzero(single).astype(np.uint64)
    levels[0] = _Level(byte, single[byte.astype(np.int64)])

    out = np.zeros(len(asked))
    left = np.arange(len(asked))
    key = asked
    gone_total = gone_distinct = np.zeros(len(asked), np.int64)  # excluded at this order: their count here and number
    for k in order_of.values():
        level = levels[k]
        c = level.context(key)
        known = c >= 0
        total = np.where(known, level.total[c] if len(level.total) else 0, 0) - gone_total
        distinct = np.where(known, level.distinct[c] if len(level.distinct) else 0, 0) - gone_distinct
        seen = level.find(key)
        hit = seen > 0
        out[left[hit]] += np.log10((seen[hit] - 0.5) / total[hit])
        escape = ~hit & (distinct > 0)
        out[left[escape]] += np.log10(0.5 * distinct[escape] / total[escape])
        rest = ~hit
        left, c, known = left[rest], c[rest], known[rest]
        if k == 0:
            n = level.distinct[0] if len(level.distinct) else 0
            out[left] -= np.log10(256 - n)
            break
        below = _shorter(key[rest], k)
        # Followers of this context are excluded one order down: what they count there.
        counted = levels[k - 1].find(_shorter(level.keys, k))
        sums = np.add.reduceat(counted, level.first) if len(level.keys) else counted
        gone_total = np.where(known, sums[c] if len(sums) else 0, 0)
        gone_distinct = np.where(known, level.distinct[c] if len(level.distinct) else 0, 0)
        key = below
    return out


def _counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    s = values[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], (np.add.reduceat(weights[order].astype(np.int64), first) if len(s) else np.zeros(0, np.int64))


class _Unit:
    def __init__(self, table: pa.Table):
        self.ids = table.column("id")
        self.train = table.column("train").to_numpy()
        self.data, self.offsets = normalised(*ta.flat(table.column("text")))
        starts, ends, self.rows = ta.words(self.data, self.offsets, ta.PLAIN)
        self.hashes = ta.word_hashes(self.data, starts, ends)
        self.word_train = np.repeat(self.train, np.diff(self.rows))
        self.byte_train = np.repeat(self.train, np.diff(self.offsets))

    def pieces(self):
        """Row ranges of about a MB, for the arrays of eight bytes per byte."""
        at, n = 0, len(self.offsets) - 1
        while at < n:
            upto = min(n, max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + _PIECE, "right")) - 1))
            lo, hi = self.offsets[at], self.offsets[upto]
            yield at, upto, grams(self.data[lo:hi], self.offsets[at:upto + 1] - lo), self.byte_train[lo:hi]
            at = upto

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings and their number in training documents."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, g, train in self.pieces():
            # The mark rides in the lowest bit, so that plain sorting keeps it with its string.
            s = np.sort(g << np.uint64(1) | train)
            mark = (s & np.uint64(1)).astype(np.int64)
            s >>= np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            keys.append(s[first])
            counts.append(np.add.reduceat(mark, first))
        return _counted(np.concatenate(keys), np.concatenate(counts))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of the values of its strings, given those of the distinct
        strings in order.  Each piece is sorted once and looked up in that order."""
        held = []
        for a, z, g, _ in self.pieces():
            order = np.argsort(g)
            s = g[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            held.append((a, z, order.astype(np.int32), s[first], np.diff(np.append(first, len(s)))))
        keys = np.sort(np.concatenate([h[3] for h in held])) if held else np.zeros(0, np.uint64)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        out = np.zeros(len(self.offsets) - 1)
        for a, z, order, distinct, times in held:
            at = np.empty(len(order))
            at[order] = np.repeat(values[np.searchsorted(keys, distinct)], times)
            total = np.concatenate([[0.0], np.cumsum(at)])
            o = self.offsets[a:z + 1] - self.offsets[a]
            out[a:z] = total[o[1:]] - total[o[:-1]]
        return out


def pair_counts(docs: DataFrame, train: Column, text: str = "text") -> np.ndarray:
    """How often each byte follows each (zero at the start), in training documents."""

    def kernel(batches):
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, data, offsets in ta.slices(batch, "text"):
                data, offsets = normalised(data, offsets)
                before = np.zeros(len(data), np.int64)
                before[1:] = data[:-1]
                before[offsets[:-1]] = 0
                total += np.bincount(before * 256 + data, minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    rows = docs.filter(train).select(F.col(text).alias("text")).mapInArrow(kernel, "pair int, n bigint")
    out = np.zeros(65536, np.int64)
    for pair, n in rows.groupBy("pair").agg(F.sum("n")).collect():  # at most 65,536 rows
        out[pair] = n
    return out.reshape(256, 256)


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """Per document the baseline of counted words and the model's log10 probability.

    ``train`` tells the documents to learn from.
    """
    layout = units.Layout(docs, text, unit_bytes)
    bits, buckets = layout.bits, layout.buckets
    pairs = pair_counts(docs, train, text)
    rows = units.by_unit(docs.withColumns({id_column: docs[id_column].cast("bigint"), "train": train}), layout, id_column, text, "train")
    shift = 8 * (ORDER + 1) - bits

    def first(table):
        u = _Unit(table)
        words, n = _counted(u.hashes, u.word_train)
        keys, counts = u.grams()
        word_cut = units.cuts(words, bits)
        gram_cut = np.concatenate([np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << np.uint64(shift)), [len(keys)]])
        for b in range(buckets):
            w, g = slice(word_cut[b], word_cut[b + 1]), slice(gram_cut[b], gram_cut[b + 1])
            head = np.array([w.stop - w.start, g.stop - g.start], np.int64).tobytes()
            yield b, head + units.pack(words[w]) + units.pack(keys[g]), units.pack(n[w]) + units.pack(counts[g])

    def meet(keys, notes):
        sizes = np.array([np.frombuffer(k[:16], np.int64) for k in keys]).reshape(-1, 2)
        words, n, strings, counts = [], [], [], []
        for k, x, (w, g) in zip(keys, notes, sizes):
            words.append(units.unpack(k[16:16 + 8 * w], np.uint64))
            strings.append(units.unpack(k[16 + 8 * w:], np.uint64))
            n.append(units.unpack(x[:8 * w], np.int64))
            counts.append(units.unpack(x[8 * w:], np.int64))
        word, total = _counted(np.concatenate(words), np.concatenate(n))
        asked, learnt = _counted(np.concatenate(strings), np.concatenate(counts))
        asked_natural = _natural(asked)
        some = learnt > 0
        logs = log_probabilities(asked_natural, asked_natural[some], learnt[some], pairs).astype(np.float32)
        known = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
        out = []
        for w, g in zip(words, strings):
            c = total[np.searchsorted(word, w)]
            out.append(np.array([len(w), len(g)], np.int64).tobytes() + known + units.pack(c) + units.pack(logs[np.searchsorted(asked, g)]))
        return out

    def rate(table, replies):
        u = _Unit(table)
        counts, logs, tokens, kinds = [], [], 0, 0
        for r in replies:
            w, g, n, v = np.frombuffer(r[:32], np.int64)
            counts.append(units.unpack(r[32:32 + 8 * w], np.int64))
            logs.append(units.unpack(r[32 + 8 * w:], np.float32))
            tokens, kinds = tokens + int(n), kinds + int(v)
        words, back = np.unique(u.hashes, return_inverse=True)
        c = np.concatenate(counts)[back] if len(back) else np.zeros(0, np.int64)
        part = np.log10(c + 1.0)
        edge = np.concatenate([[0.0], np.cumsum(part)])
        scores = u.sums(np.concatenate(logs) if logs else np.zeros(0, np.float32))
        return pa.table({
            "doc_id": u.ids.cast(pa.int64()), "held_out": pa.array(~u.train), "n_tokens": pa.array(np.diff(u.rows) + 1, pa.int64()),
            "n_known": pa.array(ta.sums(c > 0, u.rows), pa.int64()), "train_tokens": pa.array(np.full(len(u.ids), tokens), pa.int64()),
            "base_score": pa.array(edge[u.rows[1:]] - edge[u.rows[:-1]], pa.float64()), "score": pa.array(scores, pa.float64()),
            "kinds": pa.array(np.full(len(u.ids), kinds), pa.int64())})

    found = units.finish(rows, units.answer(units.send(rows, first), meet), rate, RESULT + ", kinds bigint")
    ends = docs.filter(train).count()  # each training document ends once
    tokens, kinds = F.col("train_tokens") + ends, F.col("kinds") + int(ends > 0)
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), tokens.alias("train_tokens"),
        (F.col("base_score") + F.log10(F.lit(ends + 1.0)) - F.col("n_tokens") * F.log10((tokens + kinds + 1).cast("double"))).alias("base_score"),
        "score")
