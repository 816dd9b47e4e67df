"""Scores of submissions, forecasters and ensembles against measurements.

All operators work for every challenge at once.  ``forecasts`` is long:
(resource_id, challenge_id, user_id, variable, datetime, value);
``measurements`` is (resource_id, datetime, value).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.functions import metrics as M
from quorumcast.functions.timegrid import day_start, elapsed_seconds, minutes_interval, slot_start, to_zone
from quorumcast.operators.asof import sums_between
from quorumcast.operators.grid import range_join
from quorumcast.operators.profiles import chunk_losses, is_packed

SERIES = ("resource_id", "datetime")


#: Own metric: (observed, forecast, level) to an aggregate column.
Scorer = Callable[[Column, Column, Column], Column]


def align(forecasts: DataFrame, measurements: DataFrame, how: str = "left") -> DataFrame:
    """Put the observed value next to each forecast.

    The key (resource, slot) spreads even a single hot resource over as many
    partitions as it has slots.
    """
    observed = measurements.select(*SERIES, F.col("value").alias("observed"))
    return forecasts.withColumnRenamed("value", "forecast").join(observed, list(SERIES), how)


def quantiles_wide(aligned: DataFrame, keys: Sequence[str], quantiles: Sequence[str] = M.QUANTILES) -> DataFrame:
    """One row per (keys, slot) with a column per quantile and the observed value."""
    picks = [F.max(F.when(F.col("variable") == q, F.col("forecast"))).alias(q) for q in quantiles]
    present = [F.max(F.when(F.col("variable") == q, F.lit(True)).otherwise(F.lit(False))).alias(f"has_{q}") for q in quantiles]
    return aligned.groupBy("resource_id", "datetime", *[k for k in keys if k != "resource_id"]).agg(
        F.max("observed").alias("observed"), *picks, *present
    )


def skill_scores(
    forecasts: DataFrame,
    measurements: DataFrame,
    keys: Sequence[str] = ("resource_id", "challenge_id", "user_id"),
    quantiles: Sequence[str] = M.QUANTILES,
    metrics: Sequence[str] = ("pinball", "rmse", "mae", "winkler"),
    how: str = "left",
    scorers: Mapping[str, Scorer] | None = None,
) -> DataFrame:
    """Score rows (keys, variable, metric, value).

    q50 gets pinball, rmse and mae, other quantiles pinball; the interval score
    is written to both of its bounds and left out when a bound was not submitted.
    Pairs with a missing side are skipped; with none left the value is NULL.

    ``scorers`` adds own metrics by name, for every quantile: each is a function of
    the observed column, the forecast column and the level that returns an aggregate.

    Quantiles are first brought side by side per slot, so the losses of all
    quantiles and the interval score come out of one partial+final aggregate.
    """
    keys = list(keys)
    wide = quantiles_wide(align(forecasts, measurements, how), keys, quantiles)
    o = F.col("observed")
    aggs: list[Column] = []
    rows: list[Column] = []

    def emit(present: Column, variable: str, metric: str, column: str) -> None:
        rows.append(
            F.when(present, F.struct(F.lit(variable).alias("variable"), F.lit(metric).alias("metric"), F.col(column).alias("value")))
        )

    for q in quantiles:
        f = F.col(q)
        aggs.append(F.bool_or(f"has_{q}").alias(f"any_{q}"))
        if "pinball" in metrics:
            aggs.append(M.pinball(o, f, M.quantile_level(F.lit(q))).alias(f"pinball_{q}"))
            emit(F.col(f"any_{q}"), q, "pinball", f"pinball_{q}")
        for name, scorer in (scorers or {}).items():
            aggs.append(scorer(o, f, M.quantile_level(F.lit(q))).alias(f"{name}_{q}"))
            emit(F.col(f"any_{q}"), q, name, f"{name}_{q}")
        if q == "q50":
            if "rmse" in metrics:
                aggs.append(M.rmse(o, f).alias("rmse_q50"))
                emit(F.col("any_q50"), q, "rmse", "rmse_q50")
            if "mae" in metrics:
                aggs.append(M.mae(o, f).alias("mae_q50"))
                emit(F.col("any_q50"), q, "mae", "mae_q50")
    if "winkler" in metrics and {"q10", "q90"} <= set(quantiles):
        aggs.append(M.winkler(F.col("q10"), F.col("q90"), o).alias("winkler"))
        both = F.col("any_q10") & F.col("any_q90")
        emit(both, "q10", "winkler", "winkler")
        emit(both, "q90", "winkler", "winkler")
    scored = wide.groupBy(*keys).agg(*aggs)
    return scored.select(*keys, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def observation_loss(variable: Column, observed: Column, forecast: Column) -> Column:
    """Squared error for q50, pinball loss for any other quantile."""
    return F.when(variable == "q50", M.squared_error_obs(observed, forecast)).otherwise(
        M.pinball_obs(observed, forecast, M.quantile_level(variable))
    )


def loss_to_score(variable: Column, mean_loss: Column) -> Column:
    """Root of the mean for q50, the mean itself otherwise; rounded."""
    return M.stable_round(F.when(variable == "q50", F.sqrt(mean_loss)).otherwise(mean_loss))


def series_losses(forecasts: DataFrame, measurements: DataFrame, chunk_minutes: int) -> DataFrame:
    """Loss sums and counts per (resource, user, variable, chunk of time)."""
    pairs = align(forecasts, measurements, "inner").filter(
        F.col("observed").isNotNull() & F.col("forecast").isNotNull()
    )
    loss = observation_loss(F.col("variable"), F.col("observed"), F.col("forecast"))
    chunk = slot_start(F.col("datetime"), chunk_minutes)
    return pairs.groupBy("resource_id", "user_id", "variable", chunk.alias("datetime")).agg(
        F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("n")
    )


def _aligned_to(ts: Column, chunk_minutes: int) -> Column:
    """Fail rather than score a window that cuts through a chunk."""
    off = F.pmod(elapsed_seconds(day_start(ts), ts), F.lit(chunk_minutes * 60)) != 0
    return F.when(off, F.raise_error(F.lit("a challenge start is not on a chunk edge")).cast("timestamp_ntz")).otherwise(ts)


def recent_scores(forecasts: DataFrame, measurements: DataFrame, challenges: DataFrame,
                  n_days: int = 6, chunk_minutes: int = 15, slot_minutes: int = 15) -> DataFrame:
    """Score per (challenge, user, variable) over the ``n_days`` before its start.

    With a ``launch_time`` in ``challenges`` the lookback ends at the last slot
    known then.

    Each slot's loss belongs to the lookback of several challenges.  Losses are
    therefore summed per time chunk first and only the chunk sums are joined to
    the challenges; a chunk of a day makes that join 24 to 96 times smaller.
    ``chunk_minutes`` must divide every lookback edge (checked).  ``forecasts`` may be packed profiles.
    """
    if is_packed(forecasts):
        chunks = chunk_losses(forecasts, measurements, chunk_minutes, slot_minutes, observation_loss)
    else:
        chunks = series_losses(forecasts, measurements, chunk_minutes)
    start = _aligned_to(F.col("start_datetime"), chunk_minutes)
    end = start
    if "launch_time" in challenges.columns:
        known = slot_start(F.col("launch_time"), slot_minutes) + minutes_interval(slot_minutes)
        end = F.least(start, _aligned_to(known, chunk_minutes))
    windows = challenges.select(
        "challenge_id", "resource_id", (start - minutes_interval(n_days * 1440)).alias("_from"), end.alias("_end")
    )
    sums = range_join(chunks, windows, "_from", "_end", include_end=False).groupBy(
        "resource_id", "challenge_id", "user_id", "variable"
    ).agg(F.sum("loss").alias("loss"), F.sum("n").alias("n_samples"))
    score = loss_to_score(F.col("variable"), F.col("loss") / F.col("n_samples"))
    return sums.select("resource_id", "challenge_id", "user_id", "variable", score.alias("score"), "n_samples")


def daily_scores(forecasts: DataFrame, measurements: DataFrame, resources: DataFrame) -> DataFrame:
    """Mean observation loss per forecaster, variable and local calendar day."""
    zones = resources.select("resource_id", "timezone")
    rows = align(forecasts, measurements, "inner").join(zones, "resource_id")
    day = F.to_date(to_zone(F.col("datetime"), F.col("timezone")))
    loss = observation_loss(F.col("variable"), F.col("observed"), F.col("forecast"))
    return rows.groupBy("resource_id", "user_id", "variable", day.alias("local_day")).agg(
        M.stable_round(F.avg(loss), 6).alias("score")
    )


def assessment_report(forecasts: DataFrame, measurements: DataFrame, challenges: DataFrame, valid: DataFrame,
                      n_days: int = 6, eval_days: int = 8, history_days: int | None = None) -> DataFrame:
    """Recent and past score of each eligible forecaster, missing forecasts counted as zero.

    Recent: ``eval_days`` from ``n_days`` before the start.  Past: all that lies before,
    or up to ``history_days`` before the start.  Starts must be at midnight (checked).
    Only sums of days are looked up, two for each challenge and series.

    A missing forecast of zero has the loss of the observation alone, so per day
    the loss of "all zero" plus each series' difference to it gives the imputed
    sum without writing out a row per missing slot.
    """
    zero = F.lit(0.0)
    observed = measurements.filter(F.col("value").isNotNull())
    base = observed.select("resource_id", "datetime", F.col("value").alias("observed"))
    levels = F.explode(F.array(*[F.lit(q) for q in M.QUANTILES]))
    day = day_start(F.col("datetime"))
    zero_loss = observation_loss(F.col("variable"), F.col("observed"), zero)
    base_days = base.withColumn("variable", levels).groupBy("resource_id", "variable", day.alias("datetime")).agg(
        F.sum(zero_loss).alias("loss"), F.count(F.lit(1)).alias("n")
    )
    gain = observation_loss(F.col("variable"), F.col("observed"), F.col("forecast")) - zero_loss
    series_days = (
        align(forecasts, observed, "inner").filter(F.col("forecast").isNotNull())
        .groupBy("resource_id", "user_id", "variable", day.alias("datetime")).agg(F.sum(gain).alias("gain"))
    )
    start = _aligned_to(F.col("start_datetime"), 1440)
    begins = challenges.select("challenge_id", "resource_id", start.alias("_start"))
    if history_days is None:
        first = base.groupBy("resource_id").agg(day_start(F.min("datetime")).alias("_first"))
        begins = begins.join(first, "resource_id").withColumn("_from", F.least("_first", "_start"))
    else:
        begins = begins.withColumn("_from", F.col("_start") - minutes_interval(history_days * 1440))
    windows = begins.select(
        "challenge_id", "resource_id", "_from",
        (F.col("_start") - minutes_interval(n_days * 1440)).alias("_recent"),
        (F.col("_start") + minutes_interval((eval_days - n_days) * 1440)).alias("_to"),
    )
    # Sums of days between two moments are differences of running sums, looked up as of each moment:
    # a challenge costs its own marks and not a row for every day before it.
    edges = ["past", "recent", "end"]
    marks = windows.select("challenge_id", "resource_id", F.col("_from").alias("past"), F.greatest("_from", "_recent").alias("recent"), F.col("_to").alias("end"))
    asked = valid.select("challenge_id", "user_id").withColumn("variable", levels)
    base_sums = sums_between(base_days, marks.withColumn("variable", levels), ["resource_id", "variable"], edges, "datetime", ["loss", "n"]) \
        .filter(F.col("past_n") + F.col("recent_n") > 0)
    series_sums = sums_between(series_days, marks.join(asked, "challenge_id"), ["resource_id", "user_id", "variable"], edges, "datetime", ["gain"]) \
        .drop("resource_id")
    # Forecasters to report: the eligible ones of the challenge, in every quantile.
    rows = asked.join(base_sums, ["challenge_id", "variable"]).join(
        series_sums, ["challenge_id", "user_id", "variable"], "left"
    )

    def score(name: str) -> Column:
        total = F.col(f"{name}_loss") + F.coalesce(F.col(f"{name}_gain"), zero)
        # Differences of sums can end a rounding error below zero.
        return loss_to_score(F.col("variable"), F.greatest(total / F.col(f"{name}_n"), zero))

    return rows.select(
        "resource_id", "challenge_id", "user_id", "variable",
        F.when(F.col("recent_n") > 0, score("recent")).alias("recent_score"),
        F.when(F.col("past_n") > 0, score("past")).alias("past_score"),
        F.coalesce("recent_n", F.lit(0)).alias("n_recent_samples"),
        F.coalesce("past_n", F.lit(0)).alias("n_past_samples"),
    )


def quantile_slice(forecasts: DataFrame, variable: str) -> DataFrame:
    return forecasts.filter(F.col("variable") == variable)


def five_numbers(value: str, digits: int = M.SCORE_DIGITS) -> list[Column]:
    """min, q1, median, q3, max of a group as columns; for groups bounded by a challenge or a month."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        M.stable_round(F.min(value), digits).alias("min"),
        M.stable_round(q[0], digits).alias("q1"),
        M.stable_round(q[1], digits).alias("median"),
        M.stable_round(q[2], digits).alias("q3"),
        M.stable_round(F.max(value), digits).alias("max"),
    ]


def mse_boxplot(forecasts: DataFrame, measurements: DataFrame,
                keys: Sequence[str] = ("resource_id", "challenge_id", "user_id")) -> DataFrame:
    """Five-number summary and size of the squared errors of q50."""
    rows = align(quantile_slice(forecasts, "q50"), measurements, "inner")
    err = rows.withColumn("_e", M.squared_error_obs(F.col("observed"), F.col("forecast"))).filter(F.col("_e").isNotNull())
    return err.groupBy(*keys).agg(*five_numbers("_e"), F.count(F.lit(1)).alias("n_samples"))


def winkler_boxplot(forecasts: DataFrame, measurements: DataFrame,
                    keys: Sequence[str] = ("resource_id", "challenge_id", "user_id")) -> DataFrame:
    """Five-number summary of interval scores and the values beyond 1.5 interquartile ranges.

    The collected list holds at most one value per slot of the challenge.
    """
    wide = quantiles_wide(align(forecasts, measurements, "inner"), list(keys), ("q10", "q90"))
    scored = wide.withColumn("_w", M.winkler_obs(F.col("q10"), F.col("q90"), F.col("observed"))).filter(F.col("_w").isNotNull())
    q = F.percentile("_w", F.array(F.lit(0.25), F.lit(0.75)))
    box = scored.groupBy(*keys).agg(*five_numbers("_w"), q.alias("_q"), F.sort_array(F.collect_list("_w")).alias("_all"))
    spread = F.lit(1.5) * (F.col("_q")[1] - F.col("_q")[0])
    outside = F.filter("_all", lambda x: (x < F.col("_q")[0] - spread) | (x > F.col("_q")[1] + spread))
    return box.withColumn("outliers", outside).drop("_q", "_all")


def evaluate_strategies(ensembles: DataFrame, measurements: DataFrame,
                        keys: Sequence[str] = ("strategy",), quantiles: Sequence[str] = M.QUANTILES) -> DataFrame:
    """One row per strategy and variable, plus an ``interval`` row with the interval score."""
    keys = list(keys)
    rows = align(ensembles, measurements, "inner").filter(F.col("observed").isNotNull())
    o, f = F.col("observed"), F.col("forecast")
    is_mid = F.col("variable") == "q50"
    known = rows.filter(f.isNotNull())
    level = M.quantile_level(F.col("variable"))
    per_variable = known.groupBy(*keys, "variable").agg(
        F.count(F.lit(1)).alias("n_observations"),
        M.rmse(o, F.when(is_mid, f)).alias("rmse"),
        M.mae(o, F.when(is_mid, f)).alias("mae"),
        M.pinball(o, f, level).alias("pinball"),
        F.lit(None).cast("double").alias("winkler"),
    )
    extra = [c for c in ("challenge_id",) if c in rows.columns]
    wide = quantiles_wide(rows, [*keys, *[c for c in extra if c not in keys]], ("q10", "q90"))
    w = M.winkler_obs(F.col("q10"), F.col("q90"), o)
    none = F.lit(None).cast("double")
    interval = wide.filter(F.col("q10").isNotNull() & F.col("q90").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), M.stable_round(F.avg(w)).alias("winkler")
    ).select(*keys, F.lit("interval").alias("variable"), "n_observations",
             none.alias("rmse"), none.alias("mae"), none.alias("pinball"), "winkler")
    return per_variable.unionByName(interval)


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """Mean of each metric per strategy and variable."""
    return scores.groupBy("strategy", "variable").agg(
        *[M.stable_round(F.avg(m)).alias(m) for m in ("rmse", "mae", "pinball", "winkler")]
    )


def strategy_metrics_wide(ensembles: DataFrame, measurements: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """One row per strategy with all metrics as columns."""
    keys = list(keys)
    extra = [c for c in ("resource_id", "challenge_id") if c in ensembles.columns and c not in keys]
    wide = quantiles_wide(align(ensembles, measurements, "inner"), [*keys, *extra]).filter(F.col("observed").isNotNull())
    o = F.col("observed")
    return wide.groupBy(*keys).agg(
        M.rmse(o, F.col("q50")).alias("rmse"), M.mae(o, F.col("q50")).alias("mae"),
        *[M.pinball(o, F.col(q), M.quantile_level(F.lit(q))).alias(f"pinball_{q}") for q in M.QUANTILES],
        M.winkler(F.col("q10"), F.col("q90"), o).alias("winkler"),
    )


def forecaster_scorecard(forecasts: DataFrame, measurements: DataFrame, ensembles: DataFrame | None = None,
                         max_samples: int | None = None, keys: Sequence[str] = ("resource_id",)) -> DataFrame:
    """Per forecaster and variable: samples, metrics, coverage, and the ensemble's q50 on the same slots.

    A ``winkler`` row follows when both bounds exist.  ``ensembles`` holds one
    strategy's forecasts.
    """
    keys = list(keys)
    rows = align(forecasts, measurements, "inner").filter(F.col("observed").isNotNull() & F.col("forecast").isNotNull())
    o, f, is_mid = F.col("observed"), F.col("forecast"), F.col("variable") == "q50"
    bounds = rows.filter(F.col("variable").isin("q10", "q90"))  # other rows are not sent for the interval score
    if ensembles is not None:
        # On the key the rows have met the measurements by, so that they are not shuffled again.
        e = ensembles.filter(F.col("variable") == "q50").select(
            F.col("resource_id").alias("_r"), F.col("datetime").alias("_t"), F.col("value").alias("ensemble"))
        same = (F.col("resource_id") == F.col("_r")) & (F.col("datetime") == F.col("_t")) & is_mid
        rows = rows.join(e, same, "left").drop("_r", "_t")
    else:
        rows = rows.withColumn("ensemble", F.lit(None).cast("double"))
    e = F.col("ensemble")
    none = F.lit(None).cast("double")
    per_variable = rows.groupBy(*keys, "user_id", "variable").agg(
        F.count(F.lit(1)).alias("n_samples"),
        M.rmse(o, F.when(is_mid, f)).alias("rmse"), M.mae(o, F.when(is_mid, f)).alias("mae"),
        M.pinball(o, f, M.quantile_level(F.col("variable"))).alias("pinball"), none.alias("winkler"),
        M.rmse(o, e).alias("ensemble_rmse"), M.mae(o, e).alias("ensemble_mae"),
    )
    extra = [c for c in ("challenge_id",) if c in rows.columns]
    wide = quantiles_wide(bounds, [*keys, "user_id", *extra], ("q10", "q90"))
    both = wide.filter(F.col("q10").isNotNull() & F.col("q90").isNotNull())
    interval = both.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("n_samples"), M.winkler(F.col("q10"), F.col("q90"), o).alias("winkler")
    ).select(*keys, "user_id", F.lit("winkler").alias("variable"), "n_samples", none.alias("rmse"), none.alias("mae"),
             none.alias("pinball"), "winkler", none.alias("ensemble_rmse"), none.alias("ensemble_mae"))
    coverage = F.round(F.col("n_samples") / max_samples * 100, 1) if max_samples else none
    return per_variable.unionByName(interval).withColumn("coverage_pct", coverage)
