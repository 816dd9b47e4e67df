import os

from pyspark.sql import functions as F

from quorumcast.sources import readers, sinks

from helpers import block, series


def test_backtest_reports_are_written_packed_and_read_back_whole(spark, tmp_path):
    f = block(spark, {"u1": range(24), "u2": range(24, 48)})
    c = series(spark, [("c1", "s1", "r1", "2024-01-01 00:00:00")], "challenge_id string, session_id string, resource_id string, datetime string")
    c = c.select("session_id", "challenge_id", "resource_id", F.col("datetime").alias("start_datetime"), F.expr("datetime + INTERVAL 23 HOUR").alias("end_datetime"))
    sessions = c.select("session_id", "resource_id", F.expr("start_datetime - INTERVAL 14 HOUR").alias("launch_time"))
    made = f.filter("user_id = 'u1'").withColumnRenamed("user_id", "strategy")
    sinks.write_backtest_reports(sessions, c, made, f, f"{tmp_path}/out", compression="gzip")
    for part, rows in (("sessions", 1), ("forecasts", 24), ("submissions", 48)):
        files = [n for n in os.listdir(f"{tmp_path}/out/{part}") if n.startswith("part-")]
        assert files and all(n.endswith(".csv.gz") for n in files)
        assert spark.read.option("header", True).csv(f"{tmp_path}/out/{part}").count() == rows
    sent = spark.read.option("header", True).csv(f"{tmp_path}/out/submissions")
    assert sorted(float(r.value) for r in sent.collect()) == [float(i) for i in range(48)]


def test_series_become_columns_without_a_shuffle_per_series(spark):
    f = block(spark, {"u1": [1, 5], "u2": [2, None], "other": [9, 9]}).unionByName(block(spark, {"u1": [3, 4], "u2": [None, None]}))
    series_name, names = F.concat_ws("_", "user_id", "variable"), ["u1_q50", "u2_q50", "u3_q50"]
    got = readers.pivot_forecasts(f, ["resource_id", "datetime"], series_name, names)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = f.withColumn("s", series_name).groupBy("resource_id", "datetime").pivot("s", names).agg(F.max("value"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_challenges_of_one_day_share_a_row_of_the_training_table(spark, tmp_path):
    """Two challenges of a use case that hold the same slot, one of them listed twice, make one row, written as told."""
    f = block(spark, {"u1": [1, 2]}).unionByName(block(spark, {"u2": [3, 4]}, challenge="c2")).unionByName(block(spark, {"u1": [7, 0]}, challenge="c3"))
    ends = "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS start_datetime, TIMESTAMP_NTZ '2024-01-01 01:00:00' AS end_datetime"
    c = spark.sql(f"SELECT id AS challenge_id, use AS use_case, {ends} FROM VALUES ('c1', 'load'), ('c1', 'load'), ('c2', 'load'), ('c3', 'wind') AS x(id, use)")
    m = series(spark, [("r1", "2024-01-01 00:00:00", 5.0)], "resource_id string, datetime string, value double")
    sinks.export_training_data(f, m, c, ["u1", "u2"], f"{tmp_path}/t", ("q50",), 60, compression="gzip")
    back = spark.read.option("header", True).csv(f"{tmp_path}/t")
    got = sorted((r.use_case, r.datetime[11:13], r.u1_q50, r.u2_q50, r.target) for r in back.collect())
    assert got == [("load", "00", "1.0", "3.0", "5.0"), ("load", "01", "2.0", "4.0", None), ("wind", "00", "7.0", None, "5.0"), ("wind", "01", "0.0", None, None)]
    assert all(n.endswith(".gz") for _, _, files in os.walk(f"{tmp_path}/t") for n in files if n.startswith("part-"))
