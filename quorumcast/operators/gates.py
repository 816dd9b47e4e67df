"""Who and what is eligible: completeness, history and cleaning rules.

Each gate is one aggregate with map-side combine followed by a semi or anti join
on (challenge, user); no gate collects a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.functions.metrics import QUANTILES
from quorumcast.functions.timegrid import day_start, minutes_interval, slot_count
from quorumcast.operators.grid import USE_CASES, forecast_grid, range_join

SLOT_MINUTES = 15


def drop_empty_challenges(challenges: DataFrame, submissions: DataFrame) -> DataFrame:
    return challenges.join(submissions.select("challenge_id"), "challenge_id", "left_semi")


def submission_history_gate(forecasts: DataFrame, lookback_days: int = 7, min_days: int = 6,
                            slots_per_day: int = 96, guard: str = "resource") -> DataFrame:
    """Forecasters (resource_id, user_id) with enough recent submissions in every variable.

    When nobody qualifies nobody is removed; ``guard`` says whether that is
    decided per resource or over all of them.
    """
    if guard not in ("resource", "global"):
        raise ValueError("guard must be 'resource' or 'global'")
    series = ["resource_id", "user_id", "variable"]
    # Per series and day first: counts of whole days inside the lookback add up, and on the day of
    # its edge the times themselves (as many as a day has slots) are looked at.
    times = forecasts.select(*series, "datetime", "value").groupBy(*series, day_start(F.col("datetime")).alias("_day")).agg(
        F.max("datetime").alias("_last"), F.count("value").alias("_n"),
        F.collect_list(F.when(F.col("value").isNotNull(), F.col("datetime"))).alias("_times"))
    last = times.groupBy(*series).agg(F.max("_last").alias("_end"))
    edge = F.col("_end") - minutes_interval(lookback_days * 1440)
    inside = F.when(F.col("_day") >= edge, F.col("_n")).otherwise(F.size(F.filter("_times", lambda t: t >= edge)))
    per_user = (
        times.join(last, series).groupBy(*series).agg(F.sum(inside).alias("_n"))
        .groupBy("resource_id", "user_id").agg((F.min("_n") >= min_days * slots_per_day).alias("_ok"))
    )
    if guard == "global":
        nobody = per_user.agg((F.count(F.when(F.col("_ok"), 1)) == 0).alias("_none")).scalar()
        return per_user.filter(F.col("_ok") | nobody).select("resource_id", "user_id")
    any_ok = per_user.groupBy("resource_id").agg(F.max("_ok").alias("_any"))
    return per_user.join(any_ok, "resource_id").filter(F.col("_ok") | ~F.col("_any")).select("resource_id", "user_id")


def restrict_to_history(forecasts: DataFrame, passed: DataFrame) -> DataFrame:
    """Forecasts of the (resource_id, user_id) pairs that passed the history gate."""
    return forecasts.join(passed.select("resource_id", "user_id"), ["resource_id", "user_id"], "left_semi")


def _count_of(variable: str) -> Column:
    return F.count(F.when(F.col("variable") == variable, F.col("value")))


def complete_quantile_forecasters(forecasts: DataFrame, challenges: DataFrame,
                                  quantiles: Sequence[str] = QUANTILES, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """(challenge_id, user_id) with a value for every slot of every quantile."""
    counts = forecasts.groupBy("challenge_id", "user_id").agg(*[_count_of(q).alias(q) for q in quantiles])
    expected = challenges.select(
        "challenge_id", slot_count(F.col("start_datetime"), F.col("end_datetime"), slot_minutes).alias("_expected")
    )
    full = [F.col(q) == F.col("_expected") for q in quantiles]
    cond = full[0]
    for c in full[1:]:
        cond = cond & c
    return counts.join(expected, "challenge_id").filter(cond).select("challenge_id", "user_id")


def forecasters_with_history(forecasts: DataFrame, valid: DataFrame, min_samples: int = 96 * 31) -> DataFrame:
    """(resource_id, user_id, variable, n_samples) of valid forecasters with a long enough history."""
    keys = [c for c in ("resource_id", "user_id") if c in valid.columns]
    return (
        forecasts.groupBy("resource_id", "user_id", "variable").agg(F.count("value").alias("n_samples"))
        .filter(F.col("n_samples") >= min_samples)
        .join(valid.select(*keys), keys, "left_semi")
    )


def measurement_completeness(challenges: DataFrame, measurements: DataFrame, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Expected and available slots per challenge, and whether all are there."""
    seen = forecast_grid(challenges, slot_minutes).join(
        measurements.select("resource_id", "datetime", "value"), ["resource_id", "datetime"], "left"
    )
    counts = seen.groupBy("challenge_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count("value").alias("available")
    )
    return counts.withColumn("is_complete", F.col("expected") == F.col("available"))


def measurement_completeness_gate(challenges: DataFrame, measurements: DataFrame, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    ok = measurement_completeness(challenges, measurements, slot_minutes).filter("is_complete")
    return challenges.join(ok.select("challenge_id"), "challenge_id", "left_semi")


def complete_normal_submitters(submissions: DataFrame, quantiles: Sequence[str] = QUANTILES) -> DataFrame:
    """(challenge_id, user_id) whose normal submissions are exactly the quantile list."""
    once = [F.count(F.when(F.col("variable") == q, 1)).alias(q) for q in quantiles]
    counts = submissions.filter(F.col("submission_type") == "normal").groupBy("challenge_id", "user_id").agg(
        F.count(F.lit(1)).alias("_n"), *once
    )
    cond = F.col("_n") == len(quantiles)
    for q in quantiles:
        cond = cond & (F.col(q) == 1)
    return counts.filter(cond).select("challenge_id", "user_id")


def fill_from_continuous(challenges: DataFrame, continuous: DataFrame, submissions: DataFrame,
                         quantiles: Sequence[str] = QUANTILES, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Submissions on behalf of users with rolling forecasts.

    A user qualifies for a challenge when the normal submissions are not complete
    already and the rolling forecasts hold exactly the quantiles, each with
    exactly the expected slots.
    """
    window = challenges.select("challenge_id", "resource_id", "start_datetime", "end_datetime")
    inside = range_join(continuous, window, "start_datetime", "end_datetime")
    inside = inside.join(complete_normal_submitters(submissions, quantiles), ["challenge_id", "user_id"], "left_anti")
    expected = slot_count(F.col("start_datetime"), F.col("end_datetime"), slot_minutes)
    counts = inside.groupBy("challenge_id", "user_id").agg(
        *[_count_of(q).alias(q) for q in quantiles],
        F.count(F.when(~F.col("variable").isin(*quantiles), 1)).alias("_other"),
        F.max(expected).alias("_expected"),
    )
    cond = F.col("_other") == 0
    for q in quantiles:
        cond = cond & (F.col(q) == F.col("_expected"))
    ready = counts.filter(cond).select("challenge_id", "user_id")
    return inside.join(ready, ["challenge_id", "user_id"], "left_semi").select(
        "resource_id", "challenge_id", "user_id", "variable", "datetime", "value",
        F.lit("continuous").alias("submission_type"),
    )


def drop_partial_submissions(scores: DataFrame, submissions: DataFrame, n_quantiles: int = 3) -> DataFrame:
    """Remove scores of (challenge, user) pairs whose submission count is not the number of quantiles."""
    partial = (
        submissions.groupBy("challenge_id", "user_id").agg(F.count("variable").alias("_n"))
        .filter(F.col("_n") != n_quantiles)
    )
    return scores.join(partial.select("challenge_id", "user_id"), ["challenge_id", "user_id"], "left_anti")


def drop_dates(scores: DataFrame, days: Iterable[str]) -> DataFrame:
    days = list(days)
    if not days:
        return scores
    if not all(isinstance(d, str) for d in days):
        raise TypeError("days must be ISO date strings")
    return scores.filter(~F.col("target_day").isin([F.lit(d).cast("date") for d in days]))


def drop_fixed_payment(scores: DataFrame, participation: DataFrame) -> DataFrame:
    """Remove fixed-payment users of the resource."""
    fixed = participation.filter("is_fixed_payment").select("resource_id", "user_id")
    return scores.join(fixed, ["resource_id", "user_id"], "left_anti")


def active_resources(resources: DataFrame) -> DataFrame:
    return resources.filter("is_active")


def restrict_to_valid(forecasts: DataFrame, valid: DataFrame) -> DataFrame:
    """Series of valid forecasters only, by exact (challenge or resource, user)."""
    keys = [c for c in ("challenge_id", "resource_id", "user_id") if c in valid.columns]
    return forecasts.join(valid.select(*keys), keys, "left_semi")


def validate_dataset(measurements: DataFrame, forecast_columns: Sequence[str], resources: DataFrame,
                     quantiles: Sequence[str] = QUANTILES, min_history_days: int = 8,
                     missing_warning_pct: float = 10.0) -> DataFrame:
    """Data-quality report: one row per (resource, check) with level and detail.

    ``measurements`` keeps its NULL rows; ``forecast_columns`` are the columns of
    the wide forecast file without the values.
    """
    named = [c for c in forecast_columns if c != "datetime"]
    good = [c for c in named if c.rpartition("_")[0] and c.rpartition("_")[2] in quantiles]
    stats = measurements.groupBy("resource_id").agg(
        F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
    )
    r = resources.select("resource_id", "timezone", "use_case").join(stats, "resource_id", "left")
    # First valid launch is min_history_days in, the last one a day before the end.
    long_enough = F.col("first") + minutes_interval(min_history_days * 1440) < F.col("last") - minutes_interval(1440)
    missing_pct = F.round(F.col("missing") / F.col("n") * 100, 1)

    def check(name: str, level: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), level.alias("level"), detail.cast("double").alias("detail"))

    def must(cond: Column) -> Column:
        return F.when(cond, "ok").otherwise("error")

    def should(cond: Column) -> Column:
        return F.when(cond, "ok").otherwise("warning")

    rows = F.array(
        check("timezone_given", must(F.col("timezone").isNotNull()), F.lit(None)),
        check("use_case_given", must(F.col("use_case").isNotNull()), F.lit(None)),
        check("use_case_known", should(F.col("use_case").isin(*USE_CASES)), F.lit(None)),
        check("target_present", must(F.col("n").isNotNull()), F.col("n")),
        check("datetime_column", must(F.lit("datetime" in forecast_columns)), F.lit(None)),
        check("column_naming", should(F.lit(len(good) == len(named))), F.lit(len(named) - len(good))),
        check("forecast_columns", must(F.lit(bool(good))), F.lit(len(good))),
        check("date_range", must(F.coalesce(long_enough, F.lit(False))), F.datediff("last", "first")),
        check("missing_rate", should(F.coalesce(missing_pct <= missing_warning_pct, F.lit(True))), missing_pct),
    )
    return r.select("resource_id", F.inline(rows))


def session_summary(submissions: DataFrame) -> DataFrame:
    """Variables each forecaster submitted to each challenge, in name order."""
    return submissions.groupBy("challenge_id", "user_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("variable"))).alias("variables")
    )


def session_manifest(challenges: DataFrame, submissions: DataFrame) -> DataFrame:
    """(session, challenge, user, resource, variable) rows of each session."""
    s = submissions.select("challenge_id", "user_id", "variable")
    return challenges.select("session_id", "challenge_id", "resource_id").join(s, "challenge_id").select(
        "session_id", "challenge_id", "user_id", "resource_id", "variable"
    )
