"""Benchmark decontamination with a distributed positional inverted index.

The training side is indexed in segments, each a bounded slice of documents:
for every test term the segment stores the sorted positions at which it occurs.
Segments are rows of a stored table, so the index is as distributed as the
documents and a lost executor costs the segments it was working on.  A phrase is
found by taking the posting list of its term that is rarest in the segment,
shifting it by the term's offset, and keeping the starts that the shifted lists of
the other terms also hold, rarest first.

Words are runs of ASCII letters and digits and of any other non-ASCII
characters, with A-Z lower-cased.  They are compared by 64-bit hash; a false
phrase needs as many simultaneous collisions as it has words.

Defined cases: NULL and empty texts have no words and no hits; a test item without
words is skipped, one shorter than the window is one window, and one without an id
hits like any other but is not among the items hit; documents with NULL ids and
repeated documents give one row each; empty tables give no rows (documents) or no hits (benchmark).
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumcast.llm import text_arrays as ta
from quorumcast.staging import stage

WINDOW = 13
#: Words of test items searched for at once; more items go in further blocks.
BLOCK_WORDS = 200_000
SEGMENT_BYTES = 4 << 20
_PAIRS_AT_ONCE = 1 << 20

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

INDEX_SCHEMA = ("ids array<bigint>, keys array<bigint>, word_offsets array<bigint>, terms array<int>, ends array<int>, positions array<int>")
MATCH_SCHEMA = "id bigint, k bigint, n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, items array<string>"


def _lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = ta.LOWER[data]
    starts, ends, word_offsets = ta.words(data, offsets, ALNUM)
    return ta.word_hashes(data, starts, ends), word_offsets


def hashed_terms(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _lower_words(data, np.array([0, len(data)]))[0]


class TestWindows:
    """The distinct windows of a block of test items, as numbers of its terms."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int = WINDOW):
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        rows, owners = [], []
        for name, h in items:
            t = np.searchsorted(self.vocabulary, h).astype(np.int32)
            n = max(1, len(t) - width + 1)
            grid = np.full((n, width), -1, np.int32)
            if len(t) < width:
                grid[0, :len(t)] = t
            else:
                grid[:] = np.lib.stride_tricks.sliding_window_view(t, width)
            rows.append(grid)
            owners += [name] * n
        grid = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        self.windows, number = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.lengths = (self.windows >= 0).sum(axis=1)
        order = np.argsort(number.reshape(-1), kind="stable")
        self.owners = [owners[i] for i in order]
        self.owner_ends = np.searchsorted(number.reshape(-1)[order], np.arange(len(self.windows)), "right")

    def items_of(self, window: int) -> list[str]:
        return self.owners[self.owner_ends[window - 1] if window else 0:self.owner_ends[window]]


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Test items in blocks of about ``block_words`` words, streamed to the driver.
    There is always one block, if an empty one."""
    held: list[tuple[str, np.ndarray]] = []
    n, any_block = 0, False
    for name, body in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        h = hashed_terms(body)
        if len(h) == 0:
            continue
        held.append((name, h))
        n += len(h)
        if n >= block_words:
            yield held
            held, n, any_block = [], 0, True
    if held or not any_block:
        yield held


def build_index(docs: DataFrame, vocabulary: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments with the postings of all terms in ``vocabulary`` (sorted hashes)."""

    def kernel(batches):
        for batch in batches:
            for part, data, offsets in ta.slices(batch, "text", SEGMENT_BYTES):
                h, word_offsets = _lower_words(data, offsets)
                at = np.searchsorted(vocabulary, h) if len(vocabulary) else np.zeros(len(h), np.int64)
                at[at == len(vocabulary)] = 0
                position = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
                term = at[position]
                order = np.argsort(term.astype(np.int32), kind="stable")
                terms, first = np.unique(term[order], return_index=True)
                ends = np.append(first[1:], len(order)) if len(terms) else first
                cells = (part.column("id"), part.column("k"), word_offsets, terms.astype(np.int32), ends.astype(np.int32), position[order].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, kind) if isinstance(c, np.ndarray) else c)
                     for c, kind in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                    names=["ids", "keys", "word_offsets", "terms", "ends", "positions"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(kernel, INDEX_SCHEMA)


def phrase_hits(tests: TestWindows, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray,
                word_offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every occurrence in one segment."""
    n_words = int(word_offsets[-1])
    length = np.zeros(len(tests.vocabulary) + 1, np.int64)  # the last entry stands for "no term"
    length[terms] = np.diff(ends, prepend=0)
    begin = np.zeros(len(length), np.int64)
    begin[terms] = ends - length[terms]
    term_at = np.full(n_words, -1, np.int32)
    term_at[positions] = np.repeat(terms, length[terms])
    sizes = np.where(tests.windows >= 0, length[tests.windows], np.iinfo(np.int64).max)
    live = np.flatnonzero((sizes > 0).all(axis=1))
    order = np.argsort(sizes[live], axis=1, kind="stable")
    rarest = order[:, 0]
    first_term = tests.windows[live, rarest]
    todo = length[first_term]
    groups = np.cumsum(todo) // _PAIRS_AT_ONCE
    for g in np.unique(groups):
        w = np.flatnonzero(groups == g)
        which = np.repeat(w, todo[w])
        within = np.arange(len(which)) - np.repeat(np.cumsum(todo[w]) - todo[w], todo[w])
        start = positions[begin[first_term[which]] + within].astype(np.int64) - rarest[which]
        window = live[which]
        ok = (start >= 0) & (start + tests.lengths[window] <= n_words)
        which, start, window = which[ok], start[ok], window[ok]
        for j in range(1, tests.windows.shape[1]):
            offset = order[which, j]
            term = tests.windows[window, offset]
            ok = (term < 0) | (term_at[np.minimum(start + offset, n_words - 1)] == term)
            which, start, window = which[ok], start[ok], window[ok]
        row = np.searchsorted(word_offsets, start, "right") - 1
        ok = start + tests.lengths[window] <= word_offsets[row + 1]
        yield window[ok], start[ok]


def match(index: DataFrame, tests: TestWindows) -> DataFrame:
    """One row per indexed document: its words, the hit runs of words, the items hit."""

    def kernel(batches):
        for batch in batches:
            for ids, keys, word_offsets, terms, ends, positions in zip(*[batch.column(i) for i in range(6)]):
                ids, keys = ids.values, keys.values
                word_offsets, terms, ends, positions = (x.values.to_numpy(zero_copy_only=False) for x in (word_offsets, terms, ends, positions))
                n_words = int(word_offsets[-1]) if len(word_offsets) else 0
                change = np.zeros(n_words + 1, np.int64)
                found: dict[int, set[str]] = {}
                if n_words and len(terms):
                    for window, start in phrase_hits(tests, terms, ends, positions, word_offsets):
                        np.add.at(change, start, 1)
                        np.add.at(change, start + tests.lengths[window], -1)
                        row = np.searchsorted(word_offsets, start, "right") - 1
                        for r, w in set(zip(row.tolist(), window.tolist())):
                            found.setdefault(r, set()).update(x for x in tests.items_of(w) if x is not None)
                lo, hi = ta.runs(np.cumsum(change[:n_words]) > 0, word_offsets)
                at = np.searchsorted(lo, word_offsets)
                shift = np.repeat(word_offsets[:-1], np.diff(at))
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(lo - shift, pa.int64()), pa.array(hi - shift, pa.int64())], names=["lo", "hi"]))
                items = pa.array([sorted(found.get(r, ())) for r in range(len(ids))], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(np.diff(word_offsets), pa.int64()), spans, items],
                    names=["id", "k", "n_words", "spans", "items"])

    return index.mapInArrow(kernel, MATCH_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside an occurrence of a test
    window), ``items`` (sorted) and ``k`` (hash of the text).

    Each block of test items has its own stored index and is the only thing that
    is sent to all tasks; its size is bounded by ``block_words``.
    """
    parts = None
    for number, held in enumerate(blocks(benchmark, item, item_text, block_words)):
        tests = TestWindows(held, width)
        index = stage(build_index(docs, tests.vocabulary, id_column, text), f"postings-{number}")
        found = match(index, tests).withColumn("first", F.lit(int(number == 0)))
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy("id", "k").agg(
        F.first("n_words").alias("n_words"), F.sum("first").cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Length of the union of the sorted runs.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["hi"] - F.greatest(acc["to"], s["lo"]))).alias("n"),
                                F.greatest(acc["to"], s["hi"]).alias("to")),
        lambda acc: acc["n"])
    return (merged.withColumn("n_hit", covered)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
            .select(F.col("id").alias(id_column), "k", "n_words", "n_hit", "items"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity(index: DataFrame, tests: TestWindows, first: str, second: str, most_words: int) -> DataFrame:
    """Documents in which two terms occur within ``most_words`` words of each other,
    with the number of such pairs' earlier positions."""
    a, b = (int(np.searchsorted(tests.vocabulary, hashed_terms(x))[0]) for x in (first, second))

    def kernel(batches):
        for batch in batches:
            for ids, word_offsets, terms, ends, positions in zip(*[batch.column(i) for i in (0, 2, 3, 4, 5)]):
                ids = ids.values
                word_offsets, terms, ends, positions = (x.values.to_numpy(zero_copy_only=False) for x in (word_offsets, terms, ends, positions))
                lists = []
                for t in (a, b):
                    at = int(np.searchsorted(terms, t))
                    known = at < len(terms) and terms[at] == t
                    lists.append(positions[(ends[at - 1] if at else 0):ends[at]].astype(np.int64) if known else np.zeros(0, np.int64))
                one, two = lists
                row = np.searchsorted(word_offsets, one, "right") - 1
                lo = np.searchsorted(two, np.maximum(one - most_words, word_offsets[row]))
                hi = np.searchsorted(two, np.minimum(one + most_words + 1, word_offsets[row + 1]))
                near = row[hi > lo]
                n = np.bincount(near, minlength=len(ids)) if len(near) else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), pa.array(n[n > 0], pa.int64())], names=["id", "n_near"])

    return index.mapInArrow(kernel, "id bigint, n_near bigint")
