"""Small frames for tests."""

from pyspark.sql import functions as F


def series(spark, rows, columns):
    """Rows with an ISO ``datetime`` text column turned into a timestamp."""
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def hours(n, day="2024-01-01"):
    return [f"{day} {h:02d}:00:00" for h in range(n)]


def block(spark, values, variable="q50", challenge="c1"):
    """``values``: user -> list of hourly values."""
    rows = [("r1", challenge, u, variable, t, None if v is None else float(v)) for u, vs in values.items() for t, v in zip(hours(len(vs)), vs)]
    return series(spark, rows, "resource_id string, challenge_id string, user_id string, variable string, datetime string, value double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]
