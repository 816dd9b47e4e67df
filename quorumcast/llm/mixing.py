"""Mix sources to target weights by systematic sampling.

Inside a source every document is expected ``target / source size`` times.  The
expected copies are summed up along a fixed order, one random offset is added,
and a document is emitted once for each integer its stretch of the sum crosses.
The order goes by size class first, so that long and short documents are both
taken in proportion and the words taken come near the target.

Native: DataFrame operations only.  The prefix sum of a hot source is split: the
order is cut into (size class, leading hash digits) buckets, their counts are
summed up, and rows are numbered inside a bucket only.

Defined cases: NULL text has size 0; NULL is a source of its own, the last one;
a source without words has target 0 and nothing is taken; an empty table gives
an empty result; repeated rows are separate documents.  Working columns get a
prefix that does not occur in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, source: str = "source", size: str = "size",
            weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Per source: ``source_size`` and ``target``.

    Weights repeat over the sources in code point order.  A target stops at
    ``most_times`` the source's size and the excess goes to the others by weight:
    every target is min(weight x level, cap) for the one level that uses up all
    words, found by walking the sources in the order in which they reach their cap.
    The windows run over one row per source.
    """
    whole = Window.partitionBy()
    named = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy(source).agg(F.sum(size).cast("bigint").alias("source_size")).withColumn("_w", weight.cast("bigint"))
    per = per.withColumn("_cap", F.col("source_size") * most_times).withColumn("_at", F.col("_cap") / F.col("_w"))
    walk = Window.orderBy("_at", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(walk), F.lit(0)))
                         / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(walk), F.lit(0))))
    # Levels rise along the walk while caps are passed; the first that stays within its cap is the level.
    level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(whole)["_level"]
    return per.select(source, "source_size", F.coalesce(F.least(F.col("_w") * level, F.col("_cap").cast("double")), F.lit(0.0)).alias("target"))


def copies(df: DataFrame, id_column: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED,
           weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to every row of ``df``."""
    pre = "_m"
    while any(c.startswith(pre) for c in df.columns):
        pre += "_"
    draw, digits, kind, here, ahead, rate, rank = (f"{pre}{x}" for x in ("draw", "digits", "kind", "here", "ahead", "rate", "rank"))
    bits = F.length(F.bin(size))
    step = F.when(bits < 4, F.col(size)).otherwise(bits * 8 + F.call_function("shiftright", F.col(size), bits - 4) % 8)
    rows = (
        df.withColumn(draw, F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("-")))))
        .withColumn(digits, F.substring(draw, 1, 2))
        .withColumn(kind, step.cast("bigint"))
        .withColumn(here, F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source), F.lit(""))))
    )
    bucket = [here, kind, digits]
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias(rank))
    earlier = Window.partitionBy(here).orderBy(kind, digits).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(ahead, F.coalesce(F.sum(rank).over(earlier), F.lit(0))).drop(rank)
    level = targets(df.select(F.col(source).alias("source"), F.col(size).alias("size")), "source", "size", weights, most_times)
    level = level.select(
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source"), F.lit(""))).alias(here),
        "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(here))), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    per_bucket = counts.join(level, here).withColumn(
        rate, F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    inside = Window.partitionBy(*bucket).orderBy(draw, id_column)
    placed = rows.join(per_bucket, bucket).withColumn(rank, F.col(ahead) + F.row_number().over(inside))
    crossed = F.floor(F.col(rate) * F.col(rank) + offset) - F.floor(F.col(rate) * (F.col(rank) - 1) + offset)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("source_size", "target", "copies")]
    return placed.select(*kept, "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed rows themselves: every row of ``df`` as often as it is taken."""
    size = "_size"
    while size in df.columns:
        size += "_"
    taken = copies(df.withColumn(size, word_count(F.col(text))), size=size, **options)
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.filter("copies > 0").withColumn(size, again).select(*[F.col(f"`{c}`") for c in df.columns])
