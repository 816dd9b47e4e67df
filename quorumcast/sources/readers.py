"""Scans over stored tables.

Each scan takes the tables as DataFrames (parquet, JDBC or anything Spark reads)
and covers all wanted resources in one pass.  Time limits are plain comparisons
on the stored column, so they reach the file or database scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumcast.functions.metrics import QUANTILES


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Read one table; give a schema for text formats to avoid a pass over the data to infer it."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower, upper, partitions: int, **options) -> DataFrame:
    """Read a database table in ranges of ``partition_column``, one task per range."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_column,
                                          lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()
    )


def _bound(ts) -> Column:
    return ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp_ntz")


def _only(df: DataFrame, wanted: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return df if wanted is None else df.join(wanted.select(*keys), list(keys), "left_semi")


def scan_measurements(measurements: DataFrame, start, end, resources: DataFrame | None = None) -> DataFrame:
    """Values in ``[start, end]``, one per (resource, slot): the smallest of repeated ones."""
    rows = measurements.filter((F.col("datetime") >= _bound(start)) & (F.col("datetime") <= _bound(end)))
    rows = _only(rows, resources, ["resource_id"])
    return rows.groupBy("resource_id", "datetime").agg(F.min("value").alias("value"))


def _submitted(submission_forecasts: DataFrame, submissions: DataFrame, challenges: DataFrame) -> DataFrame:
    """Forecast rows with their header; headers are joined to challenges first, being the smaller pair."""
    c = challenges.select("challenge_id", "resource_id", "target_day")
    headers = submissions.select("submission_id", "challenge_id", "user_id", "variable").join(c, "challenge_id")
    return submission_forecasts.select("submission_id", "datetime", "value").join(headers, "submission_id")


def scan_forecast_history(submission_forecasts: DataFrame, submissions: DataFrame, challenges: DataFrame,
                          start, end, wanted: DataFrame | None = None) -> DataFrame:
    """Submitted values in a time range, one per (resource, user, variable, slot).

    Repeated slots keep the smallest submission id; the aggregate combines before
    the shuffle, which a ranking window would not.
    """
    rows = submission_forecasts.filter((F.col("datetime") >= _bound(start)) & (F.col("datetime") <= _bound(end)))
    rows = _submitted(rows, submissions, challenges)
    rows = _only(rows, wanted, ["resource_id", "user_id", "variable"])
    return rows.groupBy("resource_id", "user_id", "variable", "datetime").agg(
        F.min_by("value", "submission_id").alias("value")
    )


def scan_submissions(submissions: DataFrame, challenges: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Submission headers of challenges in a range of target days."""
    c = challenges.filter(F.col("target_day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    return submissions.select("submission_id", "challenge_id", "user_id", "variable").join(
        c.select("challenge_id", "resource_id", "target_day"), "challenge_id"
    )


def challenge_submission_forecasts(submission_forecasts: DataFrame, submissions: DataFrame, challenges: DataFrame,
                                   worklist: DataFrame | None = None) -> DataFrame:
    """Submitted series of the challenges in ``worklist``, keyed by submission."""
    c = _only(challenges, worklist, ["challenge_id"])
    return _submitted(submission_forecasts, submissions, c).select(
        "challenge_id", "resource_id", "submission_id", "user_id", "variable", "datetime", "value"
    )


def unscored_challenges(challenges: DataFrame, scores: DataFrame, since: str) -> DataFrame:
    """Challenges from ``since`` on without any score."""
    return challenges.filter(F.col("target_day") >= F.lit(since).cast("date")).join(
        scores.select("challenge_id"), "challenge_id", "left_anti"
    )


def recalc_start(today: Column, grace_days: int = 2) -> Column:
    """First day whose scores are computed again: this month's first, in the grace period last month's."""
    return F.when(F.dayofmonth(today) <= grace_days, F.trunc(F.add_months(today, -1), "MM")).otherwise(F.trunc(today, "MM"))


def challenge_ensemble_forecasts(ensemble_forecasts: DataFrame, models: Sequence[str],
                                 worklist: DataFrame | None = None) -> DataFrame:
    """Ensemble series of the given models; the model takes the place of the user."""
    rows = ensemble_forecasts.filter(F.col("strategy").isin(list(models)))
    return _only(rows, worklist, ["challenge_id"]).withColumnRenamed("strategy", "user_id")


def scan_continuous_forecasts(continuous: DataFrame, start, end, wanted: DataFrame | None = None) -> DataFrame:
    rows = continuous.filter((F.col("datetime") >= _bound(start)) & (F.col("datetime") <= _bound(end)))
    return _only(rows, wanted, ["resource_id", "user_id"])


def scan_scores(scores: DataFrame, challenges: DataFrame, participation: DataFrame, first_day: str, last_day: str,
                metrics: Sequence[str], remove_fixed_payment: bool = True, strict: bool = False) -> DataFrame:
    """Scores with target day and participation type.

    A user without a participation row counts as not fixed; ``strict`` drops it.
    """
    c = challenges.filter(F.col("target_day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    rows = scores.filter(F.col("metric").isin(list(metrics))).select("challenge_id", "user_id", "variable", "metric", "value")
    rows = rows.join(c.select("challenge_id", "resource_id", "target_day"), "challenge_id")
    paid = participation.select("resource_id", "user_id", "is_fixed_payment")
    rows = rows.join(paid, ["resource_id", "user_id"], "inner" if strict else "left").withColumn(
        "is_fixed_payment", F.coalesce("is_fixed_payment", F.lit(False))
    )
    return rows.filter(~F.col("is_fixed_payment")) if remove_fixed_payment else rows


def ensemble_runs(ensemble_forecasts: DataFrame, challenges: DataFrame) -> DataFrame:
    """Distinct (challenge, resource, day) with an ensemble."""
    return challenges.select("challenge_id", "resource_id", "target_day").join(
        ensemble_forecasts.select("challenge_id"), "challenge_id", "left_semi"
    )


def forecasts_by_target_day(submission_forecasts: DataFrame, submissions: DataFrame, challenges: DataFrame,
                            first_day: str, last_day: str) -> DataFrame:
    c = challenges.filter(F.col("target_day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    return _submitted(submission_forecasts, submissions, c).select(
        "resource_id", "target_day", "user_id", "variable", "datetime", "value"
    )


def participation_types(participation: DataFrame) -> DataFrame:
    return participation.select("resource_id", "user_id", "is_fixed_payment")


def resource_dim(resources: DataFrame) -> DataFrame:
    return resources.select("resource_id", "user_id", "timezone", "use_case", "is_active")


def pivot_forecasts(rows: DataFrame, keys: Sequence[str], series: Column, names: Sequence[str]) -> DataFrame:
    """One row per ``keys`` with a column for each named series, its largest value.

    Conditional maxima and not ``pivot``, which shuffles every row by its series first and then
    a whole list of columns for each of them.  Rows that lie together already are not shuffled.
    """
    named = rows.select(*keys, series.alias("_series"), "value")
    return named.groupBy(*keys).agg(*[F.max(F.when(F.col("_series") == n, F.col("value"))).alias(n) for n in names])


def unpivot_forecasts(wide: DataFrame, resource: Column, quantiles: Sequence[str] = QUANTILES) -> DataFrame:
    """``{user}_{quantile}`` columns to rows; the quantile is what follows the last underscore."""
    series = [c for c in wide.columns if c.rpartition("_")[0] and c.rpartition("_")[2] in quantiles]
    if not series:
        raise ValueError("no column is named {user}_{quantile}")
    long = wide.withColumn("resource_id", resource).unpivot(["resource_id", "datetime"], series, "_series", "value")
    pattern = "^(.*)_(" + "|".join(quantiles) + ")$"
    return long.filter(F.col("value").isNotNull()).select(
        "resource_id", F.regexp_extract("_series", pattern, 1).alias("user_id"),
        F.regexp_extract("_series", pattern, 2).alias("variable"), "datetime", "value",
    )


def read_wide_dataset(spark: SparkSession, path: str, columns: Sequence[str], timestamp_format: str = "yyyy-MM-dd HH:mm",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Wide CSV with ``datetime`` and number columns; all-empty rows go, and of a repeated time one whole row stays.

    The order of lines is not known to a distributed reader, so the row kept is the
    one with the smallest values, column by column, an empty value counting as smallest.

    ``columns`` names the number columns and ``keys`` any text columns in front,
    so no pass over the files is spent on guessing types.
    """
    fields = [f"{k} string" for k in keys] + ["datetime timestamp_ntz"] + [f"`{c}` double" for c in columns]
    df = (
        spark.read.option("header", True).option("enforceSchema", False)
        .option("timestampNTZFormat", timestamp_format).schema(", ".join(fields)).csv(path)
    )
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]
    df = df.select(*keys, "datetime", *clean).dropna(how="all", subset=list(columns))
    kept = df.groupBy(*keys, "datetime").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"))
    return kept.select(*keys, "datetime", *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def wide_measurements(wide: DataFrame, resource: Column, column: str = "target") -> DataFrame:
    return wide.select(resource.alias("resource_id"), "datetime", F.col(column).alias("value")).filter(F.col("value").isNotNull())
