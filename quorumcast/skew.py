"""Exact per-group ranking and percentiles that survive very large groups.

Spark's ``percentile`` aggregate and an un-split window both put a whole group
into one task.  That is the fastest way for ordinary groups, so it stays the
normal path.  Groups above ``heavy_rows`` rows take a second path: their value
range is cut into buckets at approximate quantiles (a mergeable sketch), each
bucket is handled by its own task, and bucket totals supply the offsets.  Both
paths give the same exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000
BUCKETS = 512
SALTS = 32


def _bucketed(distinct: DataFrame, keys: Sequence[str], value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: the position of the value among per-group splitters."""
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    splits = distinct.groupBy(*keys).agg(F.percentile_approx(value, probs, 10000).alias("_splits"))
    # The rows of a group are spread over SALTS join keys, each with its own copy of the splitters.
    splits = splits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = distinct.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    joined = salted.join(splits, [*keys, "_salt"]).drop("_salt")
    below = F.filter("_splits", lambda s: s < F.col(value))
    return joined.withColumn("_bucket", F.size(below)).drop("_splits")


def _split(rows: DataFrame, keys: list[str], heavy_rows: int, size: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary and of heavy groups.

    A size that is not known is counted where the group's rows are anyway: both sides read the
    one exchange by ``keys``, and the ordinary groups need no other.  A NULL key is never heavy,
    as the heavy path joins on the keys.
    """
    if size is not None:
        return rows.filter(F.col(size) <= heavy_rows), rows.filter(F.col(size) > heavy_rows)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    heavy = known & (F.col("_size") > heavy_rows)
    return rows.filter(~heavy).drop("_size"), rows.filter(heavy).drop("_size")


def percentile_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: dict[str, float],
    heavy_rows: int = HEAVY_ROWS,
    buckets: int = BUCKETS,
    size: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles of ``value`` per group.

    ``outputs`` maps the output column to its probability.  NULLs are skipped; a
    group with only NULLs has no row.  ``size`` names a column that already holds
    an upper bound of the group's rows and saves counting them.
    """
    keys = list(keys)
    columns = keys + [value] + ([size] if size else [])
    rows = df.select(*columns).filter(F.col(value).isNotNull())
    light, heavy = _split(rows, keys, heavy_rows, size)
    aggs = [F.percentile(value, F.lit(float(p))).alias(name) for name, p in outputs.items()]
    return light.groupBy(*keys).agg(*aggs).unionByName(_heavy_percentiles(heavy, keys, value, outputs, buckets))


def _heavy_percentiles(rows: DataFrame, keys: list[str], value: str,
                       outputs: dict[str, float], buckets: int) -> DataFrame:
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    bucketed = _bucketed(counted, keys, value, buckets)
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_bc"))
    group = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        (F.sum("_bc").over(group.orderBy("_bucket")) - F.col("_bc")).alias("_offset"),
        F.sum("_bc").over(group).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    last = F.sum("_c").over(inside) + F.col("_offset") - 1
    placed = bucketed.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, "_total", (last - F.col("_c") + 1).alias("_first"), last.alias("_last")
    )
    aggs: list[Column] = []
    for name, p in outputs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = F.max(F.when((lo >= F.col("_first")) & (lo <= F.col("_last")), F.col(value)))
        at_hi = F.max(F.when((hi >= F.col("_first")) & (hi <= F.col("_last")), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append(F.when(frac == 0, at_lo).otherwise((1 - frac) * at_lo + frac * at_hi).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def dense_rank_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    heavy_rows: int = HEAVY_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Dense rank of ``value`` (ascending, NULLs left unranked) per group."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    light, big = _split(rows, keys, heavy_rows, None)
    window = Window.partitionBy(*keys).orderBy(value)
    light = light.withColumn(out, F.dense_rank().over(window).cast("bigint"))

    bucketed = _bucketed(big.select(*keys, value).distinct(), keys, value, buckets)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_bc"))
    offsets = sizes.select(
        *keys, "_bucket",
        (F.sum("_bc").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_bc")).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    ranks = bucketed.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, (F.row_number().over(inside) + F.col("_offset")).cast("bigint").alias(out)
    )
    return light.unionByName(big.join(ranks, [*keys, value]))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, out: str = "position") -> DataFrame:
    """The ``k`` first rows per group with their 1-based position.

    The filter directly on ``row_number`` lets Spark keep at most ``k`` rows per
    group before the shuffle, so a hot group costs ``k`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k).withColumn(out, F.col(out).cast("bigint"))
