"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams by rank.  A document gets
the language whose profile is nearest by out-of-place distance: the sum of rank
differences over the document's own most frequent n-grams, an n-gram missing from
the profile counting as the profile's length.

Text is lower-cased; every run of characters that are not letters is one
separator.  Ties in count go to the n-gram with the smaller code, ties in distance to
the smaller language name.

Defined cases: NULL texts and texts without a letter get ``und`` and score 0, as do
all texts when nothing could be learned; rows with NULL language teach nothing;
empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDETERMINED = "und"
PROFILE = 300
#: Bound of the labelled sample that profiles are learned from, in documents.
MOST_TRAINING_DOCS = 20_000
_PIECE = 1 << 20
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a whole text; memory is bounded by a
    piece of text plus the distinct n-grams."""
    letter = _is_letter()
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tail = np.array([1], np.uint64)
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at:at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letter[c], c, 1).astype(np.uint64)
        if at + _PIECE >= len(text):
            c = np.append(c, np.uint64(1))
        c = np.concatenate([tail, c])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
        c = c[keep]
        old = min(2, len(tail))
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        # What lies wholly in the carried tail was counted with the piece before.
        one = c[old:] if at else c
        two = two[max(0, old - 1):] if at else two
        found = np.concatenate([one[one != 1], two, three])
        u, n = np.unique(found, return_counts=True)
        if at:
            u, back = np.unique(np.concatenate([codes, u]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n]), len(u)).astype(np.int64)
        codes, counts, tail = u, n, c[-2:]
    return codes, counts


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The ``k`` most frequent n-grams, most frequent first."""
    if len(codes) > 4 * k:  # drop what can't be among them before sorting
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    def __init__(self, ranked: dict[str, Sequence[int]], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        self.known = np.unique(np.array([g for v in ranked.values() for g in v], np.uint64))
        self.rank = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.known, np.array(ranked[name], np.uint64))] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the part of the greatest possible distance that is missing."""
        if not text or not self.names:
            return UNDETERMINED, 0.0
        mine = top(*ngram_counts(text), self.size)
        if not (mine > 1).any() or not any(ch.isalpha() for ch in text):
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.known, mine)
        at[at < len(self.known)] = np.where(self.known[at[at < len(self.known)]] == mine[at < len(self.known)], at[at < len(self.known)], len(self.known))
        rank = self.rank[:, at]
        far = np.where(rank < 0, self.size, np.minimum(self.size, np.abs(rank - np.arange(len(mine))))).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1.0 - far[best] / (self.size * len(mine)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
          size: int = PROFILE, most_docs: int = MOST_TRAINING_DOCS) -> Profiles:
    """Profiles of all languages in ``docs`` from a sample of ``most_docs`` documents in
    expectation, drawn by a hash of the id at one rate for all languages but at least
    ``most_docs`` / 20 of each where there are as many.

    To the driver comes one row per language and profile rank.
    """
    docs = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
                       F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(1 << 20)).alias("draw")).filter("text is not null and lang is not null")
    per = docs.groupBy("lang").count().collect()  # one row per language
    total = sum(r[1] for r in per)
    if not total:
        return Profiles({}, size)
    share = {r[0]: min(1.0, max(most_docs / total, most_docs / 20 / r[1])) for r in per}
    keep = F.lit(False)
    for name, s in share.items():
        keep = keep | ((F.col("lang") == name) & (F.col("draw") < int(s * (1 << 20)) + 1))
    sample = docs.filter(keep).select("lang", "text")

    def kernel(batches):
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                mine = held.setdefault(name, {})
                for g, n in zip(*(x.tolist() for x in ngram_counts(body))):
                    mine[g] = mine.get(g, 0) + n
            if sum(map(len, held.values())) > 500_000:
                yield from flush(held)
        yield from flush(held)

    def flush(held):
        for name, mine in held.items():
            if mine:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine), pa.string()), pa.array(list(mine), pa.int64()),
                                                  pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    counts = sample.mapInArrow(kernel, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([f for f in docs.schema if f.name not in (label, score)] + [StructField(label, StringType()), StructField(score, DoubleType())])
    names = [f.name for f in schema][:-2]

    def kernel(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*names, label, score])

    return docs.mapInArrow(kernel, schema)
