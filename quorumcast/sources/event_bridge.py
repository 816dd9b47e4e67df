"""Derive the forecasting tables from an ``events`` table.

``events(event_id, ts, user_id, event_type, value, props)`` holds no forecasts,
so hourly averages per resource stand in for measurements and persistence
forecasts with different lags stand in for forecasters.  One resource is one
event type within a block of users, so tables grow with the events.

All steps after the first aggregate are narrow or keyed by (resource, slot).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumcast.functions.metrics import QUANTILES
from quorumcast.functions.timegrid import elapsed_seconds, minutes_interval, slot_start, slots_between
from quorumcast.staging import join_by_measured_size, join_where_rows_are, lists_in_hash_tables, partitions_by_input, shuffle_partitions

USERS_PER_RESOURCE = 50
FORECASTERS = 15
SLOT_MINUTES = 60


def challenge_key(resource: Column, day: Column) -> Column:
    return F.concat_ws("_", resource, F.to_date(day).cast("string"))


def dealt(unpacked: DataFrame, *keys: str) -> DataFrame:
    """Rows behind an ``explode`` in an exchange of their own.

    A join on the key they are grouped by already would judge them by the few rows they come
    from, and send all of them through the driver; behind an exchange they are measured.
    """
    return unpacked.repartition(*keys)


class EventTables:
    """Lazily built tables over one events folder.

    The days are those of the events: the first and last are read once, as one row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        join_by_measured_size(spark)
        join_where_rows_are(spark)
        lists_in_hash_tables(spark)
        partitions_by_input(spark, f"{folder}/events.parquet")
        self.spark = spark
        self.events = spark.read.parquet(f"{folder}/events.parquet").filter(F.col("value").isNotNull())

    def measurements_raw(self, minutes: int = SLOT_MINUTES) -> DataFrame:
        """Mean value per resource and slot; empty slots have no row."""
        ev = self.events.select(
            F.concat_ws("_", "event_type", F.floor(F.col("user_id") / USERS_PER_RESOURCE)).alias("resource_id"),
            slot_start(F.col("ts").cast("timestamp_ntz"), minutes).alias("datetime"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )
        # Integer sums are exact, so the mean does not depend on merge order.
        return ev.groupBy("resource_id", "datetime").agg(
            (F.sum("cents").cast("double") / (F.lit(100.0) * F.count("cents"))).alias("value")
        )

    @cached_property
    def _days(self) -> tuple[Column, Column]:
        """First and last day of the events, as dates."""
        ts = F.col("ts").cast("timestamp_ntz")
        first, last = self.events.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
        return tuple(F.lit(None if d is None else d.isoformat()).cast("date") for d in (first, last))

    def _slots(self) -> tuple[Column, Column]:
        """First slot of the first day and last hour of the last day."""
        first, last = self._days
        return first.cast("timestamp_ntz"), last.cast("timestamp_ntz") + minutes_interval(23 * 60)

    def _fill(self, raw: DataFrame) -> DataFrame:
        return raw.groupBy("resource_id").agg(F.round(F.round(F.avg("value"), 9), 4).alias("fill_value"))

    def grid(self, minutes: int = SLOT_MINUTES) -> DataFrame:
        slots = self._fill(self.measurements_raw(minutes)).select(
            "resource_id", "fill_value",
            F.explode(slots_between(*self._slots(), minutes)).alias("datetime"),
        )
        return dealt(slots, "resource_id", "datetime")

    def measurements(self) -> DataFrame:
        """Gap-free hourly series: empty slots take the resource's mean."""
        return self.grid().join(self.measurements_raw(), ["resource_id", "datetime"], "left").select(
            "resource_id", "datetime", F.coalesce("value", "fill_value").alias("value")
        )

    def resources(self) -> DataFrame:
        return self.measurements_raw().select("resource_id").distinct().select(
            "resource_id",
            F.concat(F.lit("owner_"), F.col("resource_id")).alias("user_id"),
            F.lit("UTC").alias("timezone"),
            F.when(F.col("resource_id").startswith("click"), "wind_power")
            .when(F.col("resource_id").startswith("view"), "solar_power")
            .otherwise("load").alias("use_case"),
            (~F.col("resource_id").startswith("signup")).alias("is_active"),
        )

    def _user(self) -> Column:
        return F.concat(F.lit("f"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("user_id")

    def _later(self) -> Column:
        return F.col("datetime") + F.make_dt_interval(F.lit(0), F.lit(24) + F.lit(3) * F.col("k"))

    def _lagged(self, keep: Column) -> DataFrame:
        # Spread by day before the rows multiply; a plan partitioned by resource
        # alone would leave a hot resource in one task.  A series' slots of a day stay
        # together, so what is summed or listed per series combines before the shuffle.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = self.measurements().repartition(parts, "resource_id", F.to_date("datetime"))
        m = spread.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(FORECASTERS))))
        shifted = m.select("resource_id", "k", self._user(), self._later().alias("datetime"), F.col("value").alias("mid"))
        return shifted.filter(F.col("datetime") <= self._slots()[1]).filter(keep)

    def _lagged_by_challenge(self, keep: Column) -> DataFrame:
        """As ``_lagged``, with ``challenge_id`` and ``variable``: what belongs to a block lies together.

        A value is sent once for each day and quantile it becomes a forecast of, before the forecasters
        multiply it, and not with each of their rows.
        """
        seconds = elapsed_seconds(F.col("datetime"), F.col("day").cast("timestamp_ntz"))
        least = F.greatest(F.lit(1), F.ceil((seconds / 3600 - 24) / 3)).cast("int")
        most = F.least(F.lit(FORECASTERS), F.ceil(seconds / 3600 / 3) - 1).cast("int")
        hours = lambda n: F.to_date(F.col("datetime") + F.make_dt_interval(F.lit(0), F.lit(n)))
        days = self.measurements().select("resource_id", "datetime", "value", F.explode(F.sequence(hours(27), hours(24 + 3 * FORECASTERS))).alias("day"))
        within = days.filter(F.col("day") <= F.to_date(self._slots()[1])).select(
            "resource_id", challenge_key(F.col("resource_id"), F.col("day")).alias("challenge_id"),
            F.explode(F.array(*[F.lit(q) for q in QUANTILES])).alias("variable"), "datetime", "value", least.alias("least"), most.alias("most"))
        spread = within.repartition(shuffle_partitions(self.spark), "challenge_id", "variable")
        m = spread.withColumn("k", F.explode(F.when(F.col("least") <= F.col("most"), F.sequence("least", "most"))))
        shifted = m.select("resource_id", "challenge_id", "variable", "k", self._user(), self._later().alias("datetime"), F.col("value").alias("mid"))
        return shifted.filter(F.col("datetime") <= self._slots()[1]).filter(keep)

    @staticmethod
    def _quantile() -> Column:
        """The value of a forecaster's quantile."""
        k = F.col("k").cast("double")
        return F.when(F.col("variable") == "q10", F.col("mid") * (F.lit(0.4) + F.lit(0.02) * k)) \
            .when(F.col("variable") == "q50", F.col("mid")).otherwise(F.col("mid") * (F.lit(1.8) - F.lit(0.02) * k)).alias("value")

    @staticmethod
    def _quantiles(df: DataFrame) -> DataFrame:
        k = F.col("k").cast("double")
        values = F.array(
            F.struct(F.lit("q10").alias("variable"), (F.col("mid") * (F.lit(0.4) + F.lit(0.02) * k)).alias("value")),
            F.struct(F.lit("q50").alias("variable"), F.col("mid").alias("value")),
            F.struct(F.lit("q90").alias("variable"), (F.col("mid") * (F.lit(1.8) - F.lit(0.02) * k)).alias("value")),
        )
        return df.select("resource_id", "user_id", "k", "datetime", F.inline(values))

    def forecasts(self) -> DataFrame:
        """(resource_id, challenge_id, user_id, variable, datetime, value)."""
        skipped = F.pmod(F.dayofmonth("datetime") * 7 + 3 * F.col("k"), F.lit(17)) < F.when(F.col("k") > 12, 5).otherwise(1)
        return self._lagged_by_challenge(~skipped).select("resource_id", "challenge_id", "user_id", "variable", "datetime", self._quantile())

    def forecasts_gappy(self) -> DataFrame:
        """As ``forecasts``, but some q90 series are missing and some single slots are NULL."""
        no_q90 = (F.col("variable") == "q90") & (F.pmod(F.dayofmonth("datetime") + F.col("k"), F.lit(11)) == 0)
        hole = (F.hour("datetime") == F.col("k")) & (F.pmod(F.dayofmonth("datetime"), F.lit(9)) == F.pmod(F.col("k"), F.lit(9)))
        skipped = F.pmod(F.dayofmonth("datetime") * 7 + 3 * F.col("k"), F.lit(17)) < F.when(F.col("k") > 12, 5).otherwise(1)
        rows = self._lagged_by_challenge(~skipped & ~no_q90)
        return rows.select("resource_id", "challenge_id", "user_id", "variable", "datetime", F.when(~hole, self._quantile()).alias("value"))

    def continuous_forecasts(self) -> DataFrame:
        """Rolling forecasts of f10..f15; f11 lacks q90 every third day, f12 one slot every fifth."""
        day = F.dayofmonth("datetime")
        rows = self._quantiles(self._lagged(F.col("k") >= 10))
        lost = ((F.col("k") == 11) & (F.col("variable") == "q90") & (F.pmod(day, F.lit(3)) == 0)) | (
            (F.col("k") == 12) & (F.hour("datetime") == 5) & (F.pmod(day, F.lit(5)) == 0)
        )
        return rows.filter(~lost).select("user_id", "resource_id", "datetime", "variable", "value")

    def sessions(self) -> DataFrame:
        """One session a day per resource, launched 10:30 the day before."""
        days = F.sequence(*self._days)
        sessions = self.resources().select("resource_id", F.explode(days).alias("day")).select(
            F.concat(F.lit("s_"), F.date_format("day", "yyyy-MM-dd")).alias("session_id"), "resource_id",
            (F.col("day").cast("timestamp_ntz") - minutes_interval(13 * 60 + 30)).alias("launch_time"),
        )
        return dealt(sessions, "session_id", "resource_id")

    def challenges(self) -> DataFrame:
        days = F.sequence(*self._days)
        day = F.col("target_day")
        challenges = self.resources().withColumn("target_day", F.explode(days)).select(
            challenge_key(F.col("resource_id"), day).alias("challenge_id"),
            F.concat(F.lit("s_"), F.date_format(day, "yyyy-MM-dd")).alias("session_id"),
            "resource_id", "use_case", "target_day",
            day.cast("timestamp_ntz").alias("start_datetime"),
            (day.cast("timestamp_ntz") + minutes_interval(23 * 60)).alias("end_datetime"),
        )
        return dealt(challenges, "challenge_id")

    def submissions(self, forecasts: DataFrame | None = None) -> DataFrame:
        f = self.forecasts() if forecasts is None else forecasts
        keys = f.select("resource_id", "challenge_id", "user_id", "variable", F.to_date("datetime").alias("target_day")).distinct()
        return keys.select(
            F.concat_ws("_", "challenge_id", "user_id", "variable").alias("submission_id"),
            "resource_id", "challenge_id", "user_id", "variable", "target_day",
            F.lit("normal").alias("submission_type"),
        )

    def submission_forecasts(self) -> DataFrame:
        return self.forecasts().select(
            F.concat_ws("_", "challenge_id", "user_id", "variable").alias("submission_id"), "datetime", "value"
        )

    def participation(self) -> DataFrame:
        pairs = self.resources().select(
            "resource_id", F.explode(F.sequence(F.lit(1), F.lit(FORECASTERS))).alias("k")
        ).select(
            F.concat(F.lit("f"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("user_id"),
            "resource_id", (F.col("k") == FORECASTERS).alias("is_fixed_payment"),
        )
        return dealt(pairs, "user_id", "resource_id")
