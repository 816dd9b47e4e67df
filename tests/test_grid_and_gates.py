import pytest
from helpers import block, column, series
from pyspark.sql import functions as F

from quorumcast.operators import gates, grid
from quorumcast.plans import backtest


def sessions(spark, launch):
    return spark.createDataFrame([("s1", "r1", launch)], "session_id string, resource_id string, l string").select(
        "session_id", "resource_id", F.col("l").cast("timestamp_ntz").alias("launch_time"))


def resources(spark, zone="Europe/Brussels", use_case="load"):
    return spark.createDataFrame([("r1", "owner", zone, use_case)], "resource_id string, user_id string, timezone string, use_case string")


@pytest.mark.parametrize("launch,slots,start", [
    ("2024-03-30 10:30:00", 92, "2024-03-30 23:00:00"), ("2024-10-26 10:30:00", 100, "2024-10-26 22:00:00"),
    ("2024-01-10 10:30:00", 96, "2024-01-10 23:00:00"), ("2024-01-10 23:30:00", 96, "2024-01-11 23:00:00"),
])
def test_local_days_with_clock_changes(spark, launch, slots, start):
    c = grid.make_challenges(sessions(spark, launch), resources(spark))
    assert grid.forecast_grid(c).count() == slots
    assert grid.expected_leadtimes(c).first().expected_leadtimes == slots
    assert str(c.first().start_datetime) == start


def test_unknown_use_case_is_an_error(spark):
    with pytest.raises(Exception, match="invalid use_case"):
        grid.make_challenges(sessions(spark, "2024-01-10 10:30:00"), resources(spark, use_case="tea")).collect()


def test_interpolation(spark):
    s = series(spark, [("r1", "2024-01-01 00:00:00", 1.0), ("r1", "2024-01-01 01:00:00", 5.0), ("r1", "2024-01-01 01:15:00", None), ("r1", "2024-01-01 01:30:00", 7.0)],
               "resource_id string, datetime string, value double")
    assert column(grid.resample_interpolate(s, 15), "value", "datetime") == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


def test_rounded_slot(spark):
    df = series(spark, [("2024-01-01 00:07:29",), ("2024-01-01 00:07:30",), ("2024-01-01 23:55:00",)], "datetime string")
    got = [str(r[0]) for r in df.select(grid.rounded_slot(F.col("datetime"), 15)).collect()]
    assert got == ["2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-02 00:00:00"]


def challenge(spark):
    return spark.createDataFrame([("c1", "r1", "2024-01-01 00:00:00", "2024-01-01 02:00:00")], "challenge_id string, resource_id string, s string, e string").select(
        "challenge_id", "resource_id", F.col("s").cast("timestamp_ntz").alias("start_datetime"), F.col("e").cast("timestamp_ntz").alias("end_datetime"))


def three(spark, values):
    out = None
    for q in ("q10", "q50", "q90"):
        b = block(spark, values, q)
        out = b if out is None else out.unionByName(b)
    return out


def test_complete_forecasters(spark):
    f = three(spark, {"full": [1, 2, 3], "hole": [1, None, 3], "short": [1, 2]}).unionByName(block(spark, {"one": [1, 2, 3]}, "q50"))
    valid = gates.complete_quantile_forecasters(f, challenge(spark), slot_minutes=60)
    assert column(valid, "user_id", "user_id") == ["full"]
    assert gates.restrict_to_valid(f, valid).count() == 9


def test_names_that_start_alike_are_different_users(spark):
    f = three(spark, {"s1": [1, 2, 3], "s10": [1, None, 3], "model_v2": [1, 2, 3]})
    valid = gates.complete_quantile_forecasters(f, challenge(spark), slot_minutes=60)
    assert column(valid, "user_id", "user_id") == ["model_v2", "s1"]


def test_history_gate_keeps_all_when_nobody_qualifies(spark):
    f = block(spark, {"a": [1, 2, 3], "b": [1]})
    assert gates.submission_history_gate(f, min_days=1, slots_per_day=24).count() == 2
    assert column(gates.submission_history_gate(f, min_days=1, slots_per_day=3), "user_id", "user_id") == ["a"]
    other = block(spark, {"z": [1]}).withColumn("resource_id", F.lit("r2"))
    both = f.unionByName(other)
    assert gates.submission_history_gate(both, min_days=1, slots_per_day=3).count() == 2
    assert gates.submission_history_gate(both, min_days=1, slots_per_day=3, guard="global").count() == 1


def test_continuous_fill_respects_complete_submissions(spark):
    rolling = three(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2]}).drop("challenge_id")
    sent = spark.createDataFrame([("c1", "a", q, "normal") for q in ("q10", "q50", "q90")] + [("c1", "b", "q50", "normal")],
                                 "challenge_id string, user_id string, variable string, submission_type string")
    got = gates.fill_from_continuous(challenge(spark), rolling, sent, slot_minutes=60)
    assert {r.user_id for r in got.collect()} == {"b"} and got.count() == 9


def measured(spark, first, last):
    return series(spark, [("r1", first, 1.0), ("r1", last, 1.0)], "resource_id string, datetime string, value double")


def test_schedule(spark):
    m = measured(spark, "2024-01-01 00:00:00", "2024-01-20 00:00:00")
    launches = [str(x) for x in column(backtest.backtest_schedule(m), "launch_time", "launch_time")]
    assert launches[0] == "2024-01-09 10:30:00" and len(launches) == 9
    assert len(column(backtest.backtest_schedule(m, start="2024-01-10 10:30:00", n_sessions=3), "launch_time", "launch_time")) == 3
    back = column(backtest.backtest_schedule(m, end="2024-01-15 10:30:00", n_sessions=2), "launch_time", "launch_time")
    assert [str(x) for x in back] == ["2024-01-14 10:30:00", "2024-01-15 10:30:00"]
    early = column(backtest.backtest_schedule(m, start="2024-01-02 10:30:00", n_sessions=2), "launch_time", "launch_time")
    assert str(early[0]) == "2024-01-09 10:30:00"
    assert backtest.backtest_schedule(measured(spark, "2024-01-01 00:00:00", "2024-01-05 00:00:00")).count() == 0
