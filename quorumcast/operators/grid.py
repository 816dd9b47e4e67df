"""Challenges, time grids, resampling and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumcast.functions.timegrid import (
    from_zone, minutes_interval, slot_count, slot_start, slots_between, to_zone,
)

# The use cases a resource may have.
USE_CASES = ("wind_power", "wind_power_ramp", "solar_power", "load")


def make_challenges(sessions: DataFrame, resources: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """One challenge per (session, resource): the local day after the launch.

    ``sessions`` has (session_id, resource_id, launch_time), as a schedule writes
    them.  Start and end are the first and last slot of the local day in UTC, so
    a day with a clock change has fewer or more slots.
    """
    pairs = sessions.select("session_id", "resource_id", "launch_time").join(
        resources.select("resource_id", "user_id", "timezone", "use_case"), "resource_id"
    )
    use_case = F.when(F.col("use_case").isin(*USE_CASES), F.col("use_case")).otherwise(
        F.raise_error(F.concat(F.lit("invalid use_case: "), F.coalesce("use_case", F.lit("NULL"))))
    )
    day = F.date_add(F.to_date(to_zone(F.col("launch_time"), F.col("timezone"))), 1)
    local = day.cast("timestamp_ntz")
    return pairs.select(
        F.concat_ws("_", "resource_id", "session_id").alias("challenge_id"),
        "session_id", "launch_time", "resource_id", "user_id", use_case.alias("use_case"), day.alias("target_day"),
        from_zone(local, F.col("timezone")).alias("start_datetime"),
        from_zone(local + minutes_interval(24 * 60 - slot_minutes), F.col("timezone")).alias("end_datetime"),
    )


def make_submissions(challenges: DataFrame, series: DataFrame) -> DataFrame:
    """Attach each forecaster series (resource_id, user_id, variable) to the challenges of its resource."""
    c = challenges.select("challenge_id", "session_id", "resource_id", "target_day")
    return series.select("resource_id", "user_id", "variable").distinct().join(c, "resource_id").select(
        F.concat_ws("_", "challenge_id", "user_id", "variable").alias("submission_id"),
        "challenge_id", "session_id", "resource_id", "user_id", "variable", "target_day",
    )


def forecast_grid(challenges: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """All slots of every challenge, both ends included."""
    slots = slots_between(F.col("start_datetime"), F.col("end_datetime"), slot_minutes)
    return challenges.select("challenge_id", "resource_id", F.explode(slots).alias("datetime"))


def expected_leadtimes(challenges: DataFrame, slot_minutes: int = 15) -> DataFrame:
    n = slot_count(F.col("start_datetime"), F.col("end_datetime"), slot_minutes)
    return challenges.select("challenge_id", "resource_id", n.alias("expected_leadtimes"))


def rounded_slot(ts: Column, minutes: int) -> Column:
    """Nearest slot, the later one when exactly between two."""
    return slot_start(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 30)), minutes)


def dataset_grid(measurements: DataFrame, challenges: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """Per resource: slots from its first measurement to its last challenge end."""
    first = measurements.groupBy("resource_id").agg(F.min("datetime").alias("first"))
    last = challenges.groupBy("resource_id").agg(F.max("end_datetime").alias("last"))
    start = rounded_slot(F.col("first"), slot_minutes)
    return first.join(last, "resource_id").select(
        "resource_id", F.explode(slots_between(start, F.col("last"), slot_minutes)).alias("datetime")
    )


def reindex(grid: DataFrame, series: DataFrame) -> DataFrame:
    """Series on the grid; slots without a row get NULL, rows off the grid vanish."""
    return grid.join(series, ["resource_id", "datetime"], "left")


def resample_mean(series: DataFrame, slot_minutes: int = 15, keys: Sequence[str] = ("resource_id",)) -> DataFrame:
    """Mean per left-closed slot; empty slots have no row (see ``reindex``)."""
    slot = slot_start(F.col("datetime"), slot_minutes)
    return series.groupBy(*keys, slot.alias("datetime")).agg(F.avg("value").alias("value"))


def resample_interpolate(series: DataFrame, slot_minutes: int = 15, keys: Sequence[str] = ("resource_id",)) -> DataFrame:
    """Value at every slot between the first and the last known time, on a straight
    line between the known times around it.

    The grid is fixed: a known time off the grid has no row of its own.  Times are
    bucketed by slot first.  A slot is reached from the last known time of the
    nearest earlier slot that has one, so one row per slot and not every known time
    is ordered, and the first of its own slot ends the line.  Repeated times
    count with their mean.
    """
    known = series.filter(F.col("value").isNotNull()).groupBy(*keys, "datetime").agg(F.avg("value").alias("value"))
    point = F.struct(F.col("datetime").alias("t"), F.col("value").alias("v"))
    slots = known.groupBy(*keys, slot_start(F.col("datetime"), slot_minutes).alias("_slot")).agg(
        F.min(point).alias("_first"), F.max(point).alias("_last"))
    # Slots are joined day by day; only each day's last slot looks beyond its day.
    day = F.to_date("_slot")
    inside = Window.partitionBy(*keys, "_day").orderBy("_slot")
    days = slots.groupBy(*keys, day.alias("_day")).agg(F.min(F.struct("_slot", "_first")).alias("_begin"))
    across = Window.partitionBy(*keys).orderBy("_day")
    after = days.select(*keys, "_day", F.lead("_begin").over(across).alias("_after"))
    pairs = slots.withColumn("_day", day).withColumn("_next", F.lead(F.struct("_slot", "_first")).over(inside)).join(after, [*keys, "_day"])
    follow = F.coalesce("_next", "_after")
    # A slot start that is itself a known time is a row; others lie on the line into the next bucket.
    own = pairs.filter(F.col("_first.t") == F.col("_slot")).select(*keys, F.col("_slot").alias("datetime"), F.col("_first.v").alias("value"))
    step = minutes_interval(slot_minutes)
    ahead = pairs.withColumn("_follow", follow).filter(F.col("_follow").isNotNull()).withColumn(
        "datetime", F.explode(F.sequence(F.col("_slot") + step, F.col("_follow._slot"), step)))
    ahead = ahead.filter(F.col("datetime") < F.col("_follow._first.t"))
    span = F.timestamp_diff("MICROSECOND", F.col("_last.t"), F.col("_follow._first.t"))
    part = F.timestamp_diff("MICROSECOND", F.col("_last.t"), F.col("datetime")) / span
    line = ahead.select(*keys, "datetime", (F.col("_last.v") + (F.col("_follow._first.v") - F.col("_last.v")) * part).alias("value"))
    return own.unionByName(line)


def days_spanned(start: Column, end: Column) -> Column:
    """Calendar days touched by ``[start, end]``: the equality key of range joins."""
    return F.sequence(F.to_date(start), F.to_date(end))


def range_join(facts: DataFrame, ranges: DataFrame, start: str, end: str,
               keys: Sequence[str] = ("resource_id",), include_end: bool = True) -> DataFrame:
    """Join fact rows to the ranges holding their ``datetime``.

    The day both sides share is part of the join key, so the join stays a hash or
    sort-merge join and a hot resource is spread over its days.
    """
    sliced = ranges.withColumn("_day", F.explode(days_spanned(F.col(start), F.col(end))))
    inside = (F.col("datetime") >= F.col(start)) & (
        (F.col("datetime") <= F.col(end)) if include_end else (F.col("datetime") < F.col(end))
    )
    return facts.withColumn("_day", F.to_date("datetime")).join(sliced, [*keys, "_day"]).filter(inside).drop("_day")


def history_cutoff(measurements: DataFrame, forecasts: DataFrame, sessions: DataFrame,
                   horizon_days: int = 3, history_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each session may see: measurements up to launch, forecasts up to launch + horizon.

    ``sessions`` needs (session_id, resource_id, launch_time).  All history is kept
    unless ``history_days`` asks for less; a session's rows are its input, so the
    result has a copy of the history for each session.
    """
    bounds = sessions.select("session_id", "resource_id", "launch_time",
                             (F.col("launch_time") + minutes_interval(horizon_days * 1440)).alias("_horizon"))
    begun = _history_start(bounds, "launch_time", history_days)
    seen = range_join(measurements, begun(measurements), "_from", "launch_time").drop("_from", "_horizon")
    given = range_join(forecasts, begun(forecasts), "_from", "_horizon").drop("_from", "_horizon")
    return seen, given


def _history_start(ranges: DataFrame, anchor: str, history_days: int | None):
    """Adds ``_from``: a number of days before the anchor, or the resource's first row."""
    def add(rows: DataFrame) -> DataFrame:
        if history_days is not None:
            return ranges.withColumn("_from", F.col(anchor) - minutes_interval(history_days * 1440))
        first = rows.groupBy("resource_id").agg(F.min("datetime").alias("_first"))
        return ranges.join(first, "resource_id").withColumn("_from", F.least("_first", anchor)).drop("_first")

    return add


def join_forecasters(grid: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every (user, variable) of a resource on every slot of its grid, NULL where nothing was sent."""
    series = forecasts.select("resource_id", "user_id", "variable").distinct()
    dense = grid.select("resource_id", "datetime").join(series, "resource_id")
    rows = forecasts.select("resource_id", "user_id", "variable", "datetime", "value")
    return dense.join(rows, ["resource_id", "user_id", "variable", "datetime"], "left")


def train_test_split(series: DataFrame, challenges: DataFrame, history_days: int | None = None,
                     include_start: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows before each challenge's start (all, unless ``history_days`` asks for less), and rows inside its window."""
    c = challenges.select("challenge_id", "resource_id", "start_datetime", "end_datetime")
    rows = series.drop("challenge_id")
    train = range_join(rows, _history_start(c, "start_datetime", history_days)(rows), "_from", "start_datetime", include_end=include_start)
    test = range_join(rows, c, "start_datetime", "end_datetime")
    extra = ("start_datetime", "end_datetime", "_from")
    return train.drop(*extra), test.drop(*extra)


def evaluation_slice(measurements: DataFrame, challenges: DataFrame) -> DataFrame:
    """Known measurements inside each challenge's window."""
    c = challenges.select("challenge_id", "resource_id", "start_datetime", "end_datetime")
    known = measurements.filter(F.col("value").isNotNull())
    return range_join(known, c, "start_datetime", "end_datetime").drop("start_datetime", "end_datetime")


def measurement_period_alignment(measurements: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Measurements between the first and last forecast of the resource."""
    span = forecasts.groupBy("resource_id").agg(F.min("datetime").alias("_lo"), F.max("datetime").alias("_hi"))
    inside = F.col("datetime").between(F.col("_lo"), F.col("_hi"))
    return measurements.join(span, "resource_id").filter(inside).drop("_lo", "_hi")
