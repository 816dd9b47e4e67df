"""Combining forecasters into ensemble forecasts, for all challenges at once.

A *block* is (resource_id, challenge_id, user_id, variable, datetime, value): the
eligible forecasters of each challenge on its slots; or the same packed into profiles (see
``profiles``), which is joined before it is unpacked.  Weights are a table
(resource_id, challenge_id, variable, user_id, weight), one row per forecaster,
about a hundred times smaller than the block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.operators.profiles import is_packed, sized, unpacked
from quorumcast.skew import HEAVY_ROWS, percentile_by
from quorumcast.staging import as_is

GROUP = ["resource_id", "challenge_id", "variable"]
SLOT = [*GROUP, "datetime"]
MEMBER = [*GROUP, "user_id"]
DEFAULT_SCORE = 999999.0


def drop_outliers(block: DataFrame, outliers: DataFrame) -> DataFrame:
    return block.join(outliers.select("challenge_id", "variable", "user_id"),
                      ["challenge_id", "variable", "user_id"], "left_anti")


def members(block: DataFrame) -> DataFrame:
    """Forecasters per (challenge, variable); duplicates collapse before the shuffle."""
    return block.select(*MEMBER).distinct()


def clip_lower(predictions: DataFrame, lower: float | None = 0.0) -> DataFrame:
    """Lower bound for predictions; ``None`` switches it off, NULL stays NULL."""
    if lower is None:
        return predictions
    low = F.lit(float(lower))
    return predictions.withColumn("value", F.when(F.col("value") < low, low).otherwise(F.col("value")))


def _slots(block: DataFrame) -> DataFrame:
    """Rows of a block to be grouped by slot; profiles are shuffled before they are unpacked (not if ``pack`` left them together), and their rows no more."""
    return unpacked(block.repartition("challenge_id", "variable") if is_packed(block) else block)


def combine(block: DataFrame, aggregate: Column) -> DataFrame:
    """One value per slot from an aggregate expression over the forecasters' ``value``."""
    return _slots(block).groupBy(*SLOT).agg(aggregate.alias("value"))


def mean_ensemble(block: DataFrame) -> DataFrame:
    return combine(block, F.avg("value"))


def median_ensemble(block: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    if is_packed(block):
        block = sized(block)  # profiles are counted and not their slots
    size = "n_forecasters" if "n_forecasters" in block.columns else None
    return percentile_by(_slots(block), SLOT, "value", {"value_": 0.5}, heavy_rows, size=size).withColumnRenamed("value_", "value")


def trimmed_mean_ensemble(block: DataFrame) -> DataFrame:
    """Mean without the smallest and the largest value of the slot; NULL below three values.

    Sum, min, max and count all combine before the shuffle, so no sort is needed.
    """
    n = F.count("value")
    return combine(block, F.when(n >= 3, (F.sum("value") - F.min("value") - F.max("value")) / (n - 2)))


def equal_weights(block: DataFrame) -> DataFrame:
    m = members(block)
    counts = m.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    return m.join(counts, GROUP).select(*MEMBER, (F.lit(1.0) / F.col("_n")).alias("weight"))


def _with_scores(block: DataFrame, scores: DataFrame) -> DataFrame:
    s = scores.select("challenge_id", "variable", "user_id", "score")
    return members(block).join(s, ["challenge_id", "variable", "user_id"], "left")


def exponential_weights(block: DataFrame, scores: DataFrame, beta: float = 0.001,
                        default_score: float = DEFAULT_SCORE, keep: Callable[[DataFrame, str], DataFrame] = as_is) -> DataFrame:
    """exp(-beta * score), normalised per (challenge, variable).

    Scores are taken relative to the best one, which leaves the ratios unchanged
    and cannot underflow for all forecasters at once; with no known score the
    weights are equal.  The table of one row per forecaster is worth keeping, as
    the lookback behind it would otherwise be scored again for each reader.
    """
    known = keep(_with_scores(block, scores).withColumn("score", F.coalesce("score", F.lit(float(default_score)))), "known-scores")
    best = known.groupBy(*GROUP).agg(F.min("score").alias("_best"))
    raw = known.join(best, GROUP).select(*MEMBER, F.exp(F.lit(-float(beta)) * (F.col("score") - F.col("_best"))).alias("_w"))
    total = raw.groupBy(*GROUP).agg(F.sum("_w").alias("_total"))
    return raw.join(total, GROUP).select(*MEMBER, (F.col("_w") / F.col("_total")).alias("weight"))


def score_normalised_weights(block: DataFrame, scores: DataFrame, beta: float = 0.001,
                             keep: Callable[[DataFrame, str], DataFrame] = as_is) -> DataFrame:
    """exp(-beta * score) normalised over all *scored* forecasters, then cut to those in the block.

    Unlike ``exponential_weights`` a scored forecaster missing from the block still
    takes its share, so the weights may sum to less than one.
    """
    s = keep(scores.filter(F.col("score").isNotNull()).select(*MEMBER, "score"), "known-scores")
    best = s.groupBy(*GROUP).agg(F.min("score").alias("_best"))
    raw = s.join(best, GROUP).select(*MEMBER, F.exp(F.lit(-float(beta)) * (F.col("score") - F.col("_best"))).alias("_w"))
    total = raw.groupBy(*GROUP).agg(F.sum("_w").alias("_total"))
    weights = raw.join(total, GROUP).select(*MEMBER, (F.col("_w") / F.col("_total")).alias("weight"))
    return weights.join(members(block), MEMBER, "left_semi")


def inverse_score_weights(block: DataFrame, scores: DataFrame) -> DataFrame:
    """1/score for positive scores, normalised; equal weights where nobody has one."""
    inv = _with_scores(block, scores).select(*MEMBER, F.when(F.col("score") > 0, 1 / F.col("score")).alias("_w"))
    total = inv.groupBy(*GROUP).agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_n"))
    w = F.when(F.col("_total").isNull(), F.lit(1.0) / F.col("_n")).otherwise(F.coalesce("_w", F.lit(0.0)) / F.col("_total"))
    return inv.join(total, GROUP).select(*MEMBER, w.alias("weight"))


def best_forecaster_weights(block: DataFrame, scores: DataFrame) -> DataFrame:
    """Weight one for the lowest score; the first forecaster by name if the best one is absent or unknown.

    Minimum of (score, user) instead of a ranking window: it combines before the
    shuffle, so a large challenge costs one row per map task.
    """
    best = scores.filter(F.col("score").isNotNull()).groupBy(*GROUP).agg(
        F.min(F.struct("score", "user_id")).getField("user_id").alias("_best")
    )
    pick = members(block).join(best, GROUP, "left").groupBy(*GROUP).agg(
        F.min("user_id").alias("_first"),
        F.max(F.when(F.col("user_id") == F.col("_best"), F.col("user_id"))).alias("_present"),
    )
    return pick.select(*GROUP, F.coalesce("_present", "_first").alias("user_id"), F.lit(1.0).alias("weight"))


def fixed_weights(block: DataFrame, weights: dict[str, float]) -> DataFrame:
    """User-supplied weights; forecasters not named get zero."""
    table = F.create_map(*[x for u, w in weights.items() for x in (F.lit(u), F.lit(float(w)))]) if weights else None
    w = F.lit(0.0) if table is None else F.coalesce(F.try_element_at(table, F.col("user_id")), F.lit(0.0))
    return members(block).withColumn("weight", w)


def weighted_sum(block: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight times value per slot; NULL values and missing weights count as nothing."""
    w = weights.select("challenge_id", "variable", "user_id", "weight")
    term = F.coalesce(F.col("weight") * F.col("value"), F.lit(0.0))
    return _slots(block.join(w, ["challenge_id", "variable", "user_id"], "left")).groupBy(*SLOT).agg(F.sum(term).alias("value"))


def compare_strategies(ensembles: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One row per slot with a value column per strategy.  Naming the strategies saves a pass over the data."""
    return ensembles.groupBy(*SLOT).pivot("strategy", list(strategies)).agg(F.first("value", ignorenulls=True))


def resolve_strategies(resources: DataFrame, assigned: DataFrame, default: str,
                       benchmarks: Sequence[str] = ()) -> DataFrame:
    """(resource_id, strategy) rows: the assigned ones, else the default, plus benchmarks without repeats."""
    base = resources.select("resource_id").join(assigned.select("resource_id", "strategy"), "resource_id", "left").select(
        "resource_id", F.coalesce("strategy", F.lit(default)).alias("strategy")
    )
    if benchmarks:
        extra = resources.select("resource_id", F.explode(F.array(*[F.lit(b) for b in benchmarks])).alias("strategy"))
        base = base.unionByName(extra)
    return base.distinct()
