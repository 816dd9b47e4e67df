"""The bucketed path must agree with the plain one, whatever the group looks like."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumcast.skew import dense_rank_by, first_k, percentile_by


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), 0.5, float(rnd.randint(0, 20))])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rnd.random()) for i in range(400)] + [("one", 3.0), ("nulls", None)]
    return spark.createDataFrame(rows, "k string, v double").cache()


def test_percentiles(skewed):
    want = {r.k: (r.a, r.b) for r in skewed.filter("v is not null").groupBy("k").agg(
        F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.75)).alias("b")).collect()}
    for heavy in (5, 1000, 10**9):
        got = {r.k: (r.a, r.b) for r in percentile_by(skewed, ["k"], "v", {"a": 0.5, "b": 0.75}, heavy, buckets=16).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_percentiles_with_a_known_size(skewed):
    sized = skewed.withColumn("n", F.when(F.col("k") == "hot", 3000).otherwise(20))
    a = {r.k: r.p for r in percentile_by(sized, ["k"], "v", {"p": 0.3}, 100, buckets=8, size="n").collect()}
    b = {r.k: r.p for r in percentile_by(skewed, ["k"], "v", {"p": 0.3}).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_dense_rank(skewed):
    want = sorted((r.k, r.v, r.d) for r in skewed.filter("v is not null").withColumn(
        "d", F.dense_rank().over(Window.partitionBy("k").orderBy("v"))).collect())
    for heavy in (5, 10**9):
        got = sorted((r.k, r.v, r.d) for r in dense_rank_by(skewed, ["k"], "v", "d", heavy, buckets=16).collect())
        assert got == want


def test_first_k_limits_before_the_shuffle(skewed):
    top = first_k(skewed.filter("v is not null"), ["k"], ["v"], 3)
    assert top.filter("k = 'hot'").count() == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_counted_behind_the_one_exchange(spark):
    rows = spark.createDataFrame([(f"k{i % 7}", float(i)) for i in range(200)] + [(None, float(i)) for i in range(40)], "k string, v double")
    out = percentile_by(rows.repartition(3), ["k"], "v", {"p": 0.5}, 28)
    got = {r.k: r.p for r in out.collect()}
    assert got == {r.k: r.p for r in rows.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p")).collect()} and None in got
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "LeftAnti" not in plan and "LeftSemi" not in plan and "ReusedExchange" in plan
