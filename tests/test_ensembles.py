import math
import random

import numpy as np
import pytest
from helpers import block, column
from pyspark.sql import functions as F

from quorumcast.operators import ensembles as ens
from quorumcast.operators import outliers as out
from quorumcast.plans import strategies as st
from quorumcast.staging import stage


def scores(spark, values, variable="q50", challenge="c1"):
    rows = [("r1", challenge, variable, u, s) for u, s in values.items()]
    return spark.createDataFrame(rows, "resource_id string, challenge_id string, variable string, user_id string, score double")


def weights_of(df):
    return {r.user_id: r.weight for r in df.collect()}


def test_mean_median_trimmed(spark):
    b = block(spark, {"a": [10, 1], "b": [20, 2], "c": [30, 3], "d": [None, 100]})
    assert column(ens.mean_ensemble(b), "value", "datetime") == [20.0, 26.5]
    assert column(ens.median_ensemble(b), "value", "datetime") == [20.0, 2.5]
    assert column(ens.trimmed_mean_ensemble(b), "value", "datetime") == [20.0, 2.5]
    assert column(ens.trimmed_mean_ensemble(block(spark, {"a": [1], "b": [2]})), "value", "datetime") == [None]


def test_exponential_weights(spark):
    b = block(spark, {"good": [1], "bad": [2], "new": [3]})
    w = weights_of(ens.exponential_weights(b, scores(spark, {"good": 10.0, "bad": 500.0, "gone": 1.0})))
    assert sum(w.values()) == pytest.approx(1) and w["new"] == 0.0
    assert w["good"] / w["bad"] == pytest.approx(math.exp(0.49))
    sharp = weights_of(ens.exponential_weights(b, scores(spark, {"good": 10.0, "bad": 500.0}), beta=0.1))
    assert sharp["good"] > w["good"]


def test_weights_are_equal_without_scores(spark):
    b = block(spark, {"a": [1], "b": [2]})
    assert weights_of(ens.exponential_weights(b, scores(spark, {"z": 1.0}))) == {"a": 0.5, "b": 0.5}
    assert weights_of(ens.inverse_score_weights(b, scores(spark, {"z": 1.0}))) == {"a": 0.5, "b": 0.5}
    assert weights_of(ens.inverse_score_weights(b, scores(spark, {"a": 1.0, "b": 3.0}))) == pytest.approx({"a": 0.75, "b": 0.25})


def test_weighted_sum_keeps_every_slot(spark):
    b = block(spark, {"a": [10, None], "b": [20, 20]})
    w = ens.fixed_weights(b, {"a": 0.5})
    assert column(ens.weighted_sum(b, w), "value", "datetime") == [5.0, 0.0]


def test_best_forecaster_and_fallbacks(spark):
    b = block(spark, {"a": [1], "b": [2]})
    pick = lambda s: weights_of(ens.best_forecaster_weights(b, scores(spark, s)))
    assert pick({"a": 2.0, "b": 1.0}) == {"b": 1.0}
    assert pick({"a": 1.0, "b": 1.0}) == {"a": 1.0}
    assert pick({"gone": 0.1, "b": 1.0}) == {"a": 1.0}
    assert pick({"a": None, "b": 5.0}) == {"b": 1.0}


def test_clip(spark):
    b = ens.mean_ensemble(block(spark, {"a": [-5, 5, None]}))
    assert column(ens.clip_lower(b), "value", "datetime") == [0.0, 5.0, None]
    assert column(ens.clip_lower(b, None), "value", "datetime") == [-5.0, 5.0, None]


def brute_dtw(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return math.sqrt(best[-1, -1])


def test_dtw_known_value():
    got = out._dtw_same_shape(np.array([[1.0, 2, 3, 4]]), np.array([[1.0, 1, 2, 5]]))
    assert got[0] == pytest.approx(math.sqrt(2))


def test_dtw_against_brute_force(spark):
    rnd = random.Random(3)
    values = {f"u{i}": [rnd.uniform(0, 10) for _ in range(8)] for i in range(5)}
    b = block(spark, values)
    mid = np.median(np.array(list(values.values())), axis=0)
    flat = [v for vs in values.values() for v in vs]
    span = max(flat) - min(flat)
    got = {r.user_id: r.distance for r in out.dtw_distance(b, out.median_profile(b)).collect()}
    for u, vs in values.items():
        assert got[u] == pytest.approx(brute_dtw(vs, mid) / span)


@pytest.mark.parametrize("distance", ["dtw", "euclidean"])
def test_outliers(spark, distance):
    values = {f"s{i}": [100 + i, 105 + i, 110 + i, 108 + i] for i in range(5)}
    values["odd"] = [500, 10, 500, 10]
    b = block(spark, values)
    assert column(out.detect_outliers(b, 20.0, distance=distance, keep=stage), "user_id", "user_id") == ["odd"]
    assert column(out.detect_outliers(b, 20.0, distance=distance, heavy_rows=2, keep=stage), "user_id", "user_id") == ["odd"]
    assert out.detect_outliers(b, 20.0, min_forecasters=7, distance=distance, keep=stage).count() == 0
    assert out.detect_outliers(block(spark, {f"s{i}": [5, 5] for i in range(5)}), distance=distance, keep=stage).count() == 0
    with pytest.raises(ValueError):
        out.detect_outliers(b, distance="cosine")


def test_registry():
    reg = st.Registry()

    @reg.register("mine")
    class Mine(st.CombineStrategy):
        def combine(self, value):
            return F.max(value)

    assert reg.is_registered("mine") and reg.list_strategies() == ["mine"] and isinstance(reg.get("mine"), Mine)
    with pytest.raises(st.StrategyError):
        reg.register("mine")(Mine)
    reg.unregister("mine")
    with pytest.raises(st.UnknownStrategy):
        reg.get("mine")
    with pytest.raises(st.UnknownStrategy):
        reg.unregister("mine")
    reg.register("mine")(Mine)
    reg.clear()
    assert reg.list_strategies() == []


def test_predict_before_fit(spark):
    with pytest.raises(st.StrategyError, match="fit"):
        st.registry.get("median").predict(block(spark, {"a": [1]}))


def test_running_strategies(spark):
    b = block(spark, {"a": [1, 2], "b": [3, 4], "c": [8, 9]})
    training = st.Training(scores=scores(spark, {"a": 1.0, "b": 2.0, "c": 3.0}), keep=stage)
    names = ["weighted_avg", "best_forecaster", "arithmetic_mean", "score_weighted", "inverse_score"]
    made = st.run_strategies(b, training, names)
    lo_hi = b.groupBy("datetime").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    outside = made.join(lo_hi, "datetime").filter((F.col("value") < F.col("lo") - 1e-9) | (F.col("value") > F.col("hi") + 1e-9))
    assert made.count() == 10 and outside.count() == 0
    for name, total in st.strategy_weights(b, training, names).groupBy("strategy").agg(F.sum("weight")).collect():
        assert total == pytest.approx(1), name
    with pytest.raises(st.UnknownStrategy):
        st.run_strategies(b, training, ["nope"])


def test_operators_start_no_job(spark):
    b = block(spark, {f"s{i}": [1 + i, 2 + i, 4 + i] for i in range(5)})
    known = scores(spark, {f"s{i}": float(i) for i in range(5)})
    spark.sparkContext.setJobGroup("lazy", "operators")
    try:
        out.detect_outliers(b)
        ens.exponential_weights(b, known)
        ens.score_normalised_weights(b, known)
        ens.median_ensemble(b)
        st.run_strategies(b, st.Training(scores=known), ["weighted_avg", "arithmetic_mean", "inverse_score"])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_outliers_are_detected_once_for_all_strategies(spark, monkeypatch):
    b = block(spark, {f"s{i}": [1 + i, 2 + i, 4 + i] for i in range(5)})
    calls = []
    monkeypatch.setattr(st, "detect_outliers", lambda *a, **k: calls.append(a) or out.detect_outliers(*a, **k))
    training = st.Training(scores=scores(spark, {f"s{i}": float(i) for i in range(5)}))
    st.run_strategies(b, training, ["weighted_avg", "arithmetic_mean"])
    st.strategy_weights(b, training, ["weighted_avg", "arithmetic_mean"])
    assert len(calls) == 1
