"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of a uniform random permutation, cut into shards, spread over the
input partitions like cards dealt from a deck: how many rows partition ``p``
sends to shard ``s`` is multivariate hypergeometric.  So the counts are drawn
first, exactly, as a small matrix on the driver; each partition then permutes
its own rows and deals them out by those counts; after the exchange each shard
permutes what it got.  No row is compared with a row of another partition.

Native: DataFrame operations only.  All randomness comes from seeded hashes of
the rows and a seeded generator, so reruns and retried tasks agree.

Defined cases: an empty table gives an empty result.  NULL keys are hashed like
values.  Rows equal in all ``key`` columns are numbered, so that each gets a place
of its own in the permutation; they share a partition.  Working columns get a prefix
that does not occur; input columns named like the two results are replaced.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

ROWS_PER_PART = 1024
MOST_PARTS = 65536


def hypergeometric(rng: random.Random, draws: int, good: int, total: int) -> int:
    """Number of ``good`` items among ``draws`` from ``total`` without replacement.

    Inversion that walks outwards from the mode, so it takes a few standard
    deviations of steps.
    """
    lo, hi = max(0, draws - (total - good)), min(draws, good)
    if lo == hi:
        return lo

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(total - good, draws - mode) - log_choose(total, draws))
    left = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    bad = total - good
    while left > 0 and (down > lo or up < hi):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(sizes: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard; shard totals differ by one at most."""
    rng = random.Random(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        left, pool, row = size, sum(room), []
        for s in range(shards):
            n = hypergeometric(rng, left, room[s], pool)
            pool -= room[s]
            room[s] -= n
            left -= n
            row.append(n)
        matrix.append(row)
    return matrix


def _free_prefix(columns: Sequence[str]) -> str:
    prefix = "_s"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def row_digest(df: DataFrame) -> Column:
    """128 bits of all columns of a row; equal rows have equal digests."""
    def part(field):
        c = F.col(f"`{field.name}`")
        text = F.to_json(F.struct(c)) if isinstance(field.dataType, (ArrayType, MapType, StructType)) else c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[part(f) for f in df.schema]))


def shuffle_rows_into_shards(df: DataFrame, shards: int, seed: int = 17, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``shuffle_into_shards`` for wide rows: digests of the rows are permuted, and the rows join their places at the end.

    Equal rows may change places with each other, so one of them meets all their places; a row is moved once.
    """
    row = _free_prefix([*df.columns, shard, slot]) + "row"
    known = df.withColumn(row, row_digest(df))
    placed = shuffle_into_shards(known.select(row), shards, [row], seed, shard, slot)
    return known.drop(shard, slot).dropDuplicates([row]).join(placed, row).drop(row)


def shuffle_into_shards(df: DataFrame, shards: int, key: Sequence[str], seed: int = 17,
                        shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, … inside the shard).

    ``key`` are the columns that tell rows apart.  The only thing the driver sees
    is one count for each of at most ``MOST_PARTS`` partitions; the matrix it sends
    back has ``shards`` numbers for each and is broadcast, some MB at most.  All columns
    go through both permutations; for wide rows see ``shuffle_rows_into_shards``.
    """
    pre = _free_prefix([*df.columns, shard, slot])
    part, copy, order, again, chunk, place, upto, ahead = (
        f"{pre}{x}" for x in ("part", "copy", "order", "again", "chunk", "place", "upto", "ahead"))
    keys = [F.col(f"`{k}`") for k in key]

    def drawn(n: int, *more: str) -> Column:
        return F.xxhash64(F.lit(seed + n), *keys, *more)

    total = df.count()
    parts = min(MOST_PARTS, max(16, total // ROWS_PER_PART))
    chunks = min(MOST_PARTS, max(1, total // shards // ROWS_PER_PART))
    dealt = df.withColumn(part, F.pmod(drawn(1), F.lit(parts)).cast("int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # one row for each of `parts` partitions
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    bounds = []
    for row in matrix:
        sums, at = [], 0
        for n in row:
            at += n
            sums.append(at)
        bounds.append(sums)
    table = df.sparkSession.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(bounds)), "array<array<bigint>>")).alias(part, upto))

    same = Window.partitionBy(part, *keys).orderBy(part)
    local = Window.partitionBy(part).orderBy(order, copy)
    sent = (
        dealt.withColumn(copy, F.row_number().over(same)).withColumn(order, drawn(2, copy)).withColumn(place, F.row_number().over(local))
        .join(F.broadcast(table), part)
        .withColumn(shard, F.size(F.filter(upto, lambda b: b < F.col(place))).cast("int"))
        .drop(part, order, upto, place)
        .withColumn(again, drawn(3, copy)).withColumn(chunk, F.pmod(drawn(4, copy), F.lit(chunks)).cast("int"))
    )
    # The second permutation: chunks of a shard in order, rows permuted in each, so that no task sorts a whole shard.
    counts = sent.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias(place))
    before = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, chunk, F.coalesce(F.sum(place).over(before), F.lit(0)).alias(ahead))
    inside = Window.partitionBy(shard, chunk).orderBy(again)
    return (
        sent.join(offsets, [shard, chunk])
        .withColumn(slot, (F.col(ahead) + F.row_number().over(inside) - 1).cast("bigint"))
        .select(*[F.col(f"`{c}`") for c in df.columns if c not in (shard, slot)], shard, slot)
    )
