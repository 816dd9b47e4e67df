import pytest
from helpers import block, column, hours, series
from pyspark.sql import functions as F

from quorumcast.functions import metrics as M
from quorumcast.operators import scoring


def pairs(spark, observed, forecast):
    return spark.createDataFrame(list(zip(map(float, observed), map(float, forecast))), "o double, f double")


def test_rmse_and_mae(spark):
    df = pairs(spark, [100, 110, 105, 95, 100], [98, 112, 103, 97, 102])
    row = df.agg(M.rmse(F.col("o"), F.col("f")).alias("rmse"), M.mae(F.col("o"), F.col("f")).alias("mae"), M.mse(F.col("o"), F.col("f")).alias("mse")).first()
    assert (row.rmse, row.mae, row.mse) == (2.0, 2.0, 4.0)


@pytest.mark.parametrize("q,forecast,want", [(0.1, 120, 18), (0.1, 80, 2), (0.9, 120, 2), (0.9, 80, 18)])
def test_pinball(spark, q, forecast, want):
    got = pairs(spark, [100], [forecast]).select(M.pinball_obs(F.col("o"), F.col("f"), q)).first()[0]
    assert got == pytest.approx(want)


def test_winkler(spark):
    df = spark.createDataFrame([(80.0, 120.0, 100.0), (80.0, 120.0, 60.0), (80.0, 120.0, 150.0), (80.0, None, 90.0)], "lo double, hi double, o double")
    assert [r[0] for r in df.select(M.winkler_obs(F.col("lo"), F.col("hi"), F.col("o"))).collect()] == [40.0, 240.0, 340.0, None]
    rows = spark.createDataFrame([(90.0, 110.0, 100.0), (100.0, 120.0, 110.0), (110.0, 130.0, 150.0)], "lo double, hi double, o double")
    assert rows.agg(M.winkler(F.col("lo"), F.col("hi"), F.col("o"))).first()[0] == 86.667


def test_quantile_names(spark):
    df = spark.createDataFrame([("q10",), ("q50",), ("Q05",), ("q90",)], "v string")
    assert [r[0] for r in df.select(M.quantile_level(F.col("v"))).collect()] == [0.1, 0.5, 0.05, 0.9]
    with pytest.raises(Exception, match="not a quantile"):
        spark.createDataFrame([("mean",)], "v string").select(M.quantile_level(F.col("v"))).collect()


def observed(spark, values):
    return series(spark, [("r1", t, None if v is None else float(v)) for t, v in zip(hours(len(values)), values)], "resource_id string, datetime string, value double")


def test_skill_scores_skip_winkler_without_both_bounds(spark):
    f = block(spark, {"a": [10, 10]}, "q50").unionByName(block(spark, {"a": [8, 8]}, "q10"))
    got = {(r.variable, r.metric) for r in scoring.skill_scores(f, observed(spark, [10, 12])).collect()}
    assert got == {("q50", "pinball"), ("q50", "rmse"), ("q50", "mae"), ("q10", "pinball")}


def test_skill_scores_skip_missing_pairs(spark):
    f = block(spark, {"a": [10, None, 14]})
    got = {r.metric: r.value for r in scoring.skill_scores(f, observed(spark, [12, 12, None])).collect()}
    assert got == {"pinball": 1.0, "rmse": 2.0, "mae": 2.0}


def test_scorecard_uses_the_forecasters_own_slots(spark):
    f = block(spark, {"half": [100, 100]})
    ensemble = block(spark, {"e": [101, 103, 500, 500]}).drop("user_id")
    row = scoring.forecaster_scorecard(f, observed(spark, [100, 100, 100, 100]), ensemble, max_samples=4).first()
    assert (row.n_samples, row.coverage_pct, row.ensemble_mae) == (2, 50.0, 2.0)
    assert scoring.forecaster_scorecard(f, observed(spark, [100] * 4)).first().coverage_pct is None


def test_recent_scores_end_at_the_launch(spark):
    f = block(spark, {"a": [10] * 6})
    c = spark.createDataFrame([("c9", "r1", "2024-01-01 05:00:00", "2024-01-01 02:30:00")], "challenge_id string, resource_id string, s string, l string").select(
        "challenge_id", "resource_id", F.col("s").cast("timestamp_ntz").alias("start_datetime"), F.col("l").cast("timestamp_ntz").alias("launch_time"))
    got = scoring.recent_scores(f, observed(spark, [11, 11, 11, 50, 50, 50]), c, chunk_minutes=60, slot_minutes=60).first()
    assert (got.score, got.n_samples) == (1.0, 3)


def test_recent_scores_reject_windows_across_chunks(spark):
    c = spark.createDataFrame([("c9", "r1", "2024-01-01 05:00:00")], "challenge_id string, resource_id string, s string").select(
        "challenge_id", "resource_id", F.col("s").cast("timestamp_ntz").alias("start_datetime"))
    with pytest.raises(Exception, match="chunk edge"):
        scoring.recent_scores(block(spark, {"a": [1]}), observed(spark, [1]), c, chunk_minutes=1440).collect()
