"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two of 64 bits differ in at most one bit in
one of the two halves.  Each half is therefore indexed under its 32 variants
with one bit wildcarded: fingerprints within one bit in that half share a
variant.  Equal variants meet by sorting on the variant key, and the full
distance is checked.

Copies are collapsed first: only distinct fingerprints are indexed.  A bucket of
equal variants is linked inside its task and leaves at most one edge per
fingerprint, however many of its pairs are close.

Defined cases: NULL and empty texts have no words and fingerprint zero, which links like
any other; fewer words than a shingle are one shingle; repeated rows share their
fingerprint; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumcast.staging import stage

SHINGLE = 3
SEED = 42
DISTANCE = 2
_PIECE = 8 << 20
#: Buckets up to this size are compared directly; larger ones by variants of the other half.
DIRECT = 2048


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in pieces of bounded size cut at white space."""
    if len(raw) <= _PIECE:
        yield raw.split()
        return
    at, rest = 0, b""
    while at < len(raw):
        piece = rest + raw[at:at + _PIECE]
        at += _PIECE
        w = piece.split()
        rest = b""
        if at < len(raw) and w and not piece[-1:].isspace():
            rest = w.pop()
        yield w
    if rest:
        yield [rest]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; each is 1 if it is set in over half the shingles' XXH64."""
    ones, n = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = words if shingle == 1 else [b" ".join(x) for x in zip(*[words[i:] for i in range(shingle)])]
            h = np.array([digest(s, seed) for s in joined], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(h)
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if n == 0 and tail:
        return digest(b" ".join(tail), seed)
    return int(np.packbits(2 * ones > n).view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long)."""

    def kernel(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64), pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(kernel, f"id {docs.schema[id_column].dataType.simpleString()}, fp bigint")


def variant_keys(fps: DataFrame) -> DataFrame:
    """64 rows for each fingerprint: half, wildcard position and remaining bits in one key."""
    def key(i):
        half, bit = F.floor(i / 32).cast("int"), (i % 32).cast("int")
        bits = F.when(half == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)))
        masked = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)))
        return F.call_function("shiftleft", i.cast("bigint"), F.lit(32)).bitwiseOR(masked)

    return fps.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), key)).alias("key"))


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


class Forest:
    """Union-find over values, each root the smallest of its tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (p := self.up.get(top, top)) != top:
            top = p
        while (p := self.up.get(x, x)) != top:
            self.up[x], x = top, p
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def close_pairs(group: np.ndarray, most: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs in ``group`` within ``most`` bits that connect whatever such
    pairs connect.  The members agree in one half up to one bit."""
    m = len(group)
    if m <= DIRECT:
        for d in range(1, m):
            i = np.flatnonzero(_close(group[:-d], group[d:], most))
            if len(i):
                yield i, i + d
        return
    # Pairs within two bits share the value with two wildcards: neighbours by such a value are
    # enough to connect all that share it, and sorting each is linear in the bucket.
    varying = int(np.bitwise_or.reduce(group ^ group[0]))
    bits = [np.uint64(1 << b) for b in range(64) if varying >> b & 1]
    for x in range(len(bits)):
        for y in range(x + 1, len(bits)):
            masked = group & ~(bits[x] | bits[y])
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            if len(same):
                yield order[same], order[same + 1]


def link_buckets(keys: np.ndarray, fps: np.ndarray, forest: Forest) -> None:
    """Link close members of equal keys; ``keys`` is sorted and holds whole buckets."""
    n = len(keys)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, n))
    small = size <= 16
    of = np.repeat(np.arange(len(cut)), size)
    for d in range(1, 16):
        i = np.flatnonzero((of[:-d] == of[d:]) & small[of[:-d]])
        if len(i) == 0:
            break
        i = i[_close(fps[i], fps[i + d], DISTANCE)]
        for a, b in zip(fps[i].tolist(), fps[i + d].tolist()):
            forest.link(a, b)
    for g in np.flatnonzero(~small):
        group = fps[cut[g]:cut[g] + size[g]]
        for i, j in close_pairs(group):
            for a, b in zip(group[i].tolist(), group[j].tolist()):
                forest.link(a, b)


def edges(fps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect all fingerprints within two bits.

    A task keeps the key it is in the middle of and a forest of what it has linked;
    the forest is flushed when it grows beyond a bound.
    """

    def emit(forest: Forest):
        pairs = forest.edges()
        a, b = (np.array([p[i] for p in pairs], np.uint64).view(np.int64) for i in (0, 1))
        forest.up.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def kernel(batches):
        forest = Forest()
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if len(keys):
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                link_buckets(keys[:last], fps[:last], forest)
                keys, fps = keys[last:], fps[last:]
            if len(forest.up) > 200_000:
                yield emit(forest)
        if len(keys):
            link_buckets(keys, fps, forest)
        yield emit(forest)

    variants = variant_keys(fps).repartition("key").sortWithinPartitions("key")
    return variants.select("key", "fp").mapInArrow(kernel, "a bigint, b bigint")


def components(links: DataFrame, name: str = "components", hold: Callable[..., DataFrame] = stage) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node with an edge.

    Labels spread along edges and jump to their label's label, so the number of
    rounds grows with the logarithm of the longest chain.  Every round is
    written to the shared folder by ``hold``.
    """
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = hold(links.select(ways).select("way.a", "way.b").distinct(), f"{name}-edges")
    labels = hold(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                   .select("node", F.least("node", "low").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = hold(spread.join(jump, "root", "left").select("node", "was", F.least("root", "further").alias("root")), f"{name}-{step}")
        if new.filter("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its id, ``fp`` and ``component_id``: the smallest id reachable over
    links of at most two bits."""
    hashed = stage(fingerprints(docs, id_column, text), "fingerprints")
    per = hashed.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(edges(per.select("fp")), "simhash")
    group = per.join(found, per["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = group.join(lowest, "root").select("fp", "component_id")
    return hashed.join(of_fp, "fp").select(F.col("id").alias(id_column), "fp", "component_id")
