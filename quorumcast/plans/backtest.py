"""Walk-forward backtests: a schedule of sessions run as one batch job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.functions.timegrid import day_start, elapsed_seconds, minutes_interval
from quorumcast.operators.asof import history_gate_as_of
from quorumcast.operators.grid import make_challenges, range_join
from quorumcast.operators.profiles import pack_history, series_days
from quorumcast.plans.session import SessionRun, session_forecast
from quorumcast.staging import stage

LAUNCH_MINUTE = 10 * 60 + 30
MIN_HISTORY_DAYS = 8


def valid_range(measurements: DataFrame, min_history_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """First and last possible launch per resource; resources with too little data have no row."""
    span = measurements.groupBy("resource_id").agg(F.min("datetime").alias("_lo"), F.max("datetime").alias("_hi"))
    return span.select(
        "resource_id",
        (F.col("_lo") + minutes_interval(min_history_days * 1440)).alias("first_valid"),
        (F.col("_hi") - minutes_interval(1440)).alias("last_valid"),
    ).filter(F.col("first_valid") < F.col("last_valid"))


def _ts(text: str | None) -> Column | None:
    return None if text is None else F.lit(text).cast("timestamp_ntz")


def backtest_schedule(measurements: DataFrame, start: str | None = None, end: str | None = None,
                      n_sessions: int | None = None, freq_hours: int = 24) -> DataFrame:
    """Launch times (session_id, resource_id, launch_time), evenly spaced, within each resource's valid range.

    Start, end and number may be given in any combination; what is missing
    follows from the others or from the data.  Each resource's list comes from
    its own range, so sessions and resources need no product.
    """
    if freq_hours <= 0 or (n_sessions is not None and n_sessions <= 0):
        raise ValueError("freq_hours and n_sessions must be positive")
    first, last = F.col("first_valid"), F.col("last_valid")
    morning = day_start(first) + minutes_interval(LAUNCH_MINUTE)
    step = freq_hours * 3600
    s, e = _ts(start), _ts(end)

    def fits(a: Column, b: Column) -> Column:
        return F.greatest(F.floor(elapsed_seconds(a, b) / step), F.lit(1))

    given = None if n_sessions is None else F.lit(n_sessions).cast("bigint")
    if s is not None and e is not None:
        begin, count = s, given if given is not None else F.greatest(F.floor(elapsed_seconds(s, e) / step) + 1, F.lit(1))
    elif s is not None:
        begin, count = s, given if given is not None else fits(s, last)
    elif e is not None and given is not None:
        begin, count = e - minutes_interval(freq_hours * 60 * (n_sessions - 1)), given
    elif e is not None:
        begin, count = morning, fits(first, e)
    else:
        begin, count = morning, given if given is not None else fits(morning, last)

    plan = valid_range(measurements).select("resource_id", "first_valid", "last_valid", begin.alias("_b"), count.alias("_n"))
    # Clamp: the end is judged from the start as asked for, the number from the moved start.
    final = F.col("_b") + F.make_dt_interval(F.lit(0), (F.lit(freq_hours) * (F.col("_n") - 1)).cast("int"))
    plan = plan.withColumn("_end", final).withColumn("_b", F.when(F.col("_b") < first, morning).otherwise(F.col("_b")))
    plan = plan.withColumn("_n", F.when(F.col("_end") > last, fits(F.col("_b"), last)).otherwise(F.col("_n")))
    launches = plan.select("resource_id", "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_i"))
    launch = F.col("_b") + F.make_dt_interval(F.lit(0), (F.col("_i") * freq_hours).cast("int"))
    return launches.select("resource_id", launch.alias("launch_time")).select(
        F.concat(F.lit("s_"), F.date_format("launch_time", "yyyy-MM-dd'T'HH:mm")).alias("session_id"), "resource_id", "launch_time"
    )


def assign_challenges(forecasts: DataFrame, challenges: DataFrame) -> DataFrame:
    """Forecast rows with the challenge whose window holds them."""
    window = challenges.select("challenge_id", "resource_id", "start_datetime", "end_datetime")
    return range_join(forecasts.drop("challenge_id"), window, "start_datetime", "end_datetime").select(
        "resource_id", "challenge_id", "user_id", "variable", "datetime", "value"
    )


def walk_forward_backtest(forecasts: DataFrame, measurements: DataFrame, resources: DataFrame, sessions: DataFrame,
                          strategies: Sequence[str], slot_minutes: int = 15, chunk_minutes: int = 15, n_score_days: int = 6,
                          params: dict[str, dict] | None = None, continuous: DataFrame | None = None, gate: dict | None = None,
                          horizon_days: int = 3, keep: Callable[[DataFrame, str], DataFrame] = stage) -> tuple[DataFrame, SessionRun]:
    """Run every session of the schedule in one job; returns the challenges and the run.

    The lookback of a session ends at its launch, so later measurements stay unseen.  ``gate``
    (options of the submission-history gate; None for none) is decided for each session by the
    rows it saw: those up to its launch plus the horizon.  ``continuous`` forecasts stand in
    for users who sent nothing complete for a session's challenge.
    """
    challenges = make_challenges(sessions, resources, slot_minutes)
    rows = assign_challenges(forecasts, challenges)
    history = keep(pack_history(forecasts, slot_minutes), "history")
    eligible = None
    if gate is not None:
        seen = challenges.select(F.col("challenge_id").alias("session_id"), "resource_id", "launch_time")
        days = series_days(history, slot_minutes, with_rows=True)
        eligible = keep(history_gate_as_of(days, seen, horizon_days, slot_minutes=slot_minutes, **gate), "eligible") \
            .withColumnRenamed("session_id", "challenge_id")
    submissions = None
    if continuous is not None:
        submissions = rows.select("challenge_id", "user_id", "variable").distinct().withColumn("submission_type", F.lit("normal"))
    run = session_forecast(
        rows, measurements, challenges, strategies, params, n_score_days, slot_minutes, chunk_minutes, keep=keep, history=history,
        continuous=continuous, submissions=submissions, eligible=eligible,
    )
    return challenges, run
