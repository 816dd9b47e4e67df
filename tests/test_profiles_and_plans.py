"""Packed profiles, as-of lookups, backtests and the scoring store."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quorumcast.operators import asof, ensembles, gates, outliers, profiles, scoring
from quorumcast.plans import backtest, scoring_run, session
from quorumcast.staging import stage

from helpers import series

LONG = "resource_id string, challenge_id string, user_id string, variable string, datetime string, value double"
DAY0 = dt.datetime(2024, 1, 1)


def at(day, hour=0):
    return str(DAY0 + dt.timedelta(days=day, hours=hour))


def random_history(rng, users=4, days=12, resources=("r1", "r2")):
    rows = []
    for r in resources:
        for u in range(users):
            for d in range(days):
                if rng.random() < 0.2 * u:
                    continue
                for q in ("q10", "q50", "q90"):
                    for h in range(24):
                        if rng.random() < 0.02:
                            continue
                        v = None if rng.random() < 0.03 * u else round(rng.uniform(0, 50), 3)
                        rows.append((r, f"{r}_{d:02d}", f"u{u}", q, at(d, h), v))
    return rows


def challenges_of(spark, rows):
    keys = sorted({(r[1], r[0]) for r in rows})
    data = [(c, r, at(int(c[-2:])), at(int(c[-2:]), 23)) for c, r in keys]
    df = spark.createDataFrame(data, "challenge_id string, resource_id string, start_datetime string, end_datetime string")
    return df.select("challenge_id", "resource_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_datetime", "end_datetime")])


def measured(spark, rng, days=12, resources=("r1", "r2")):
    rows = [(r, at(d, h), round(rng.uniform(0, 50), 3)) for r in resources for d in range(days) for h in range(24) if rng.random() > 0.05]
    return series(spark, rows, "resource_id string, datetime string, value double")


@pytest.fixture(scope="module")
def history(spark):
    rows = random_history(random.Random(1))
    return rows, series(spark, rows, LONG).cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_packing_keeps_every_row(spark, history):
    rows, df = history
    packed = profiles.pack(df.union(df), 60)
    assert packed.count() == len({r[:4] for r in rows})
    assert rows_of(profiles.unpacked(packed), *df.columns) == rows_of(df, *df.columns)
    assert profiles.unpacked(df) is df


def test_gates_on_profiles_match_gates_on_rows(spark, history):
    rows, df = history
    packed, c = profiles.pack(df, 60).cache(), challenges_of(spark, rows)
    for options in ({}, {"lookback_days": 3, "min_days": 2}, {"lookback_days": 7, "min_days": 5, "guard": "global"}):
        want = gates.submission_history_gate(df, slots_per_day=24, **options)
        got = profiles.history_gate(profiles.series_days(packed, 60), slots_per_day=24, **options)
        assert rows_of(got, "resource_id", "user_id") == rows_of(want, "resource_id", "user_id"), options
    want = gates.complete_quantile_forecasters(df, c, slot_minutes=60)
    assert rows_of(profiles.complete_users(packed, c, slot_minutes=60), "challenge_id", "user_id") == rows_of(want, "challenge_id", "user_id")
    packed.unpersist()  # a later plan of the same profiles would read, and show, what is cached


def test_presence_of_a_long_day(spark):
    """100 slots of 15 minutes, as when the clock goes back, need two words."""
    rows = [("r", "c", "u", "q50", str(DAY0 + dt.timedelta(minutes=15 * i)), None if i in (0, 70) else 1.0) for i in range(100)]
    day = profiles.series_days(profiles.pack(series(spark, rows, LONG), 15), 15).collect()[0]
    bits = [w >> b & 1 for w in day.present for b in range(64)]
    assert [i for i, b in enumerate(bits) if b] == [i for i in range(100) if i not in (0, 70)] and day.n == 98
    df = series(spark, rows, LONG)
    for hours in (1, 12, 17, 24):
        edge = df.withColumn("datetime", F.col("datetime")).agg(F.max("datetime")).first()[0] - dt.timedelta(hours=hours)
        got = spark.createDataFrame([(list(day.present), day["first"], edge)], "present array<bigint>, first timestamp_ntz, edge timestamp_ntz") \
            .select(profiles._count_from(F.col("present"), F.col("first"), F.col("edge"), 15).alias("n")).first().n
        assert got == df.filter((F.col("datetime") >= F.lit(edge)) & F.col("value").isNotNull()).count()


def test_scores_outliers_and_ensembles_on_profiles(spark, history):
    rows, df = history
    m, c = measured(spark, random.Random(2)), challenges_of(spark, rows)
    packed = profiles.with_group_size(profiles.pack(df, 60)).cache()
    for chunk in (60, 1440):
        want = scoring.recent_scores(df, m, c, 6, chunk, 60)
        assert rows_of(scoring.recent_scores(packed, m, c, 6, chunk, 60), *want.columns) == rows_of(want, *want.columns)
    for distance in ("dtw", "euclidean"):
        want = outliers.detect_outliers(df, 1.0, 3, distance)
        assert rows_of(outliers.detect_outliers(packed, 1.0, 3, distance), *want.columns) == rows_of(want, *want.columns)
    for make in (ensembles.mean_ensemble, ensembles.median_ensemble, ensembles.trimmed_mean_ensemble):
        a, b = ([(*r[:4], None if r[4] is None else round(r[4], 9)) for r in rows_of(make(x), *ensembles.SLOT, "value")] for x in (df, packed))
        assert a == b
    weights = ensembles.equal_weights(packed)
    assert rows_of(weights, *ensembles.MEMBER, "weight") == rows_of(ensembles.equal_weights(df), *ensembles.MEMBER, "weight")


def test_rolling_forecasts_stand_in_like_the_gate_says(spark, history):
    rows, df = history
    c = challenges_of(spark, rows)
    rng = random.Random(5)
    rolling = [(r, u, q, at(d, h), 1.0) for r in ("r1", "r2") for u in ("u1", "u3", "new") for d in range(12)
               for q in (("q10", "q50", "q90") if rng.random() < 0.8 else ("q10", "q50")) for h in range(24) if rng.random() > 0.002]
    cont = series(spark, rolling, "resource_id string, user_id string, variable string, datetime string, value double")
    subs = df.select("challenge_id", "user_id", "variable").distinct().withColumn("submission_type", F.lit("normal")).filter("user_id <> 'u3' OR variable <> 'q90'")
    filled = gates.fill_from_continuous(c, cont, subs, slot_minutes=60)
    sent = df.join(filled.select("challenge_id", "user_id").distinct(), ["challenge_id", "user_id"], "left_anti")
    want = rows_of(sent.select(*df.columns).unionByName(filled.select(*df.columns)), *df.columns)
    got = profiles.pack_with_continuous(df, c, cont, subs, slot_minutes=60)
    assert filled.count() and rows_of(profiles.unpacked(got), *df.columns) == want


def test_forecast_rows_are_shuffled_once(spark, history):
    """Behind the packed profiles no exchange carries single slots, up to the ensembles."""
    rows, df = history
    plan = profiles.pack(df, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    held = []

    def keep(frame, name):
        held.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return stage(frame, name)

    run = session.session_forecast(df, measured(spark, random.Random(3)), challenges_of(spark, rows), ["weighted_avg"], slot_minutes=60,
                                   chunk_minutes=1440, keep=keep, gate={"lookback_days": 3, "min_days": 1})
    assert run.ensembles.count() > 0
    assert dict(held)["profiles"].count("Exchange hashpartitioning") == 1
    assert [name for name, plan in held if "InMemoryTableScan" in plan] == ["profiles"]  # the rows as they came


def test_lookup_and_sums_between(spark):
    events = series(spark, [("a", at(0), 1.0), ("a", at(2), 10.0), ("a", at(2, 5), 100.0), ("b", at(1), 7.0)], "k string, datetime string, x double")
    marks = series(spark, [("a", 1, at(2)), ("a", 2, at(1)), ("a", 3, at(5)), ("b", 4, at(0)), ("c", 5, at(9))], "k string, id int, datetime string")
    found = {r.id: r.x for r in asof.lookup(events, marks, ["k"], "datetime", ["x"]).collect()}
    assert found == {1: 10.0, 2: 1.0, 3: 100.0, 4: None, 5: None}
    spans = spark.createDataFrame([("a", 1, at(0), at(2), at(3)), ("a", 2, at(2), at(2, 5), at(9)), ("c", 3, at(0), at(1), at(2))], "k string, id int, p string, q string, r string")
    spans = spans.select("k", "id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in "pqr"])
    got = {r.id: (r.p_x, r.q_x) for r in asof.sums_between(events, spans, ["k"], ["p", "q", "r"], "datetime", ["x"]).collect()}
    assert got == {1: (1.0, 110.0), 2: (10.0, 100.0), 3: (0.0, 0.0)}


def test_gate_as_each_session_saw_it(spark, history):
    rows, df = history
    launches = [(f"s{d}_{r}", r, at(d, 10)) for d in range(0, 12) for r in ("r1", "r2")]
    sessions = spark.createDataFrame(launches, "session_id string, resource_id string, launch_time string").withColumn("launch_time", F.col("launch_time").cast("timestamp_ntz"))
    days = profiles.series_days(profiles.pack_history(df, 60), 60, with_rows=True)
    got = asof.history_gate_as_of(days, sessions, 2, 4, 3, 60)
    want = []
    for s, r, launch in launches:
        limit = str(dt.datetime.fromisoformat(launch) + dt.timedelta(days=2))
        seen = df.filter((F.col("resource_id") == r) & (F.col("datetime") <= F.lit(limit).cast("timestamp_ntz")))
        want.append(gates.submission_history_gate(seen, 4, 3, 24).select(F.lit(s).alias("s"), "resource_id", "user_id"))
    every = want[0]
    for w in want[1:]:
        every = every.union(w)
    expected = rows_of(every, "s", "resource_id", "user_id")
    assert rows_of(got, "session_id", "resource_id", "user_id") == expected
    assert len({x[2] for x in expected}) > 1 and len(expected) < 4 * len(launches)


def test_backtest_does_not_see_later_rows(spark, history):
    rows, df = history
    m = measured(spark, random.Random(7))
    resources = spark.createDataFrame([("r1", "o", "UTC", "load"), ("r2", "o", "UTC", "load")],
                                      "resource_id string, user_id string, timezone string, use_case string")
    sessions = backtest.backtest_schedule(m, start="2024-01-09 10:30:00", n_sessions=1)
    gate = {"lookback_days": 4, "min_days": 2}

    def run(f, meas):
        made = backtest.walk_forward_backtest(f, meas, resources, sessions, ["weighted_avg", "median"], 60, 60, params={"weighted_avg": {"outlier_alpha": 3.0}},
                                              gate=gate, keep=stage)[1].ensembles
        return rows_of(made.withColumn("value", F.round("value", 9)), "strategy", *ensembles.SLOT, "value")

    late = F.col("datetime") > F.lit("2024-01-12 10:30:00").cast("timestamp_ntz")
    known = run(df, m)
    assert known == run(df.filter(~late), m.filter(F.col("datetime") <= F.lit("2024-01-09 10:30:00").cast("timestamp_ntz"))) and known


def test_a_second_scoring_run_finds_nothing_to_do(spark, history, tmp_path):
    rows, df = history
    c = challenges_of(spark, rows).withColumn("target_day", F.to_date("start_datetime")).cache()
    full = series(spark, [(r, at(d, h), 10.0 + h) for r in ("r1", "r2") for d in range(11) for h in range(24)], "resource_id string, datetime string, value double")
    made = ensembles.mean_ensemble(df).withColumn("strategy", F.lit("mean"))
    store = scoring_run.ScoreStore(spark, f"{tmp_path}/scores")

    def go(measurements, days_at_once=31):
        return scoring_run.run_pending(store, c, measurements, df, made, "2024-01-01", 60, days_at_once)

    part = full.filter(F.col("datetime") < F.lit("2024-01-04").cast("timestamp_ntz"))
    first = go(part, 2)
    assert first.filter("scored").count() == 6 and first.filter("not scored").count() == c.count() - 6
    # What a run that was cut short leaves is not read.
    store.scores().limit(5).withColumn("run", F.lit("cut")).write.partitionBy("run").mode("append").parquet(f"{store.path}/scores")
    second = go(full)
    assert second.count() == c.count() - 6 and second.filter("scored").count() == c.count() - 6 - 2
    assert go(full).filter("scored").count() == 0
    assert scoring_run.run_pending(store, c.filter("target_day < '2024-01-12'"), full, df, made, "2024-01-01", 60).count() == 0
    direct = scoring_run.score_pending_challenges(c, full, df, made, spark.createDataFrame([], "challenge_id string"), "2024-01-01", 60)
    scored = direct.outcomes.filter("scored").select("challenge_id")
    want = direct.submission_scores.withColumn("kind", F.lit("submission")).unionByName(direct.ensemble_scores.withColumn("kind", F.lit("ensemble")))
    columns = ["resource_id", "challenge_id", "user_id", "variable", "metric", "value", "kind"]
    assert rows_of(store.scores(), *columns) == rows_of(want.join(scored, "challenge_id", "left_semi"), *columns)


def test_series_are_listed_before_the_shuffle(spark, history):
    plan = profiles.pack(history[1], 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_collect_list")


def test_repeated_slots_are_averaged(spark):
    rows = [("r", "c", "u", "q50", at(0, h), v) for h, v in ((1, 2.0), (0, None), (1, 4.0), (1, None), (2, None), (2, None))]
    got = profiles.pack(series(spark, rows, LONG), 60).collect()
    assert [(p.datetime.hour, p.value) for p in got[0].points] == [(0, None), (1, 3.0), (2, None)] and got[0].n == 1 and len(got) == 1


def test_unpacked_slots_are_not_shuffled(spark, history, tmp_path):
    profiles.pack(history[1], 60).write.parquet(f"{tmp_path}/p")
    packed = spark.read.parquet(f"{tmp_path}/p")
    plan = ensembles.mean_ensemble(packed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(challenge_id" in plan


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ensembles_group_packed_profiles_where_they_are(spark, history):
    rows, df = history
    shifted = df.withColumn("value", F.col("value") + 1)  # not what another test has cached
    packed = profiles.pack(shifted, 60)
    assert shuffles(ensembles.mean_ensemble(packed)) == 1
    light = ensembles.median_ensemble(packed).filter("challenge_id IS NULL OR value IS NOT NULL")
    want = ensembles.median_ensemble(shifted)
    assert rows_of(light, *ensembles.SLOT, "value") == rows_of(want, *ensembles.SLOT, "value")


def test_a_block_without_a_key_takes_the_ordinary_path(spark):
    """Joins on the keys would lose it on the path of huge groups."""
    rows = [("r", None, f"u{u}", "q50", at(0, h), float(u)) for u in range(5) for h in range(2)]
    df = series(spark, rows, LONG)
    for block in (df, profiles.pack(df, 60)):
        got = ensembles.median_ensemble(block, heavy_rows=3)
        assert [r.value for r in got.collect()] == [2.0, 2.0]


def test_the_history_gate_lists_the_times_of_a_day(spark):
    """One row per series and day is shuffled; on the day of the lookback's edge the times decide."""
    slots = [("r1", "c", u, "q50", at(d, h), 1.0) for u in ("late", "early") for d in range(3) for h in range(24) if not (u == "early" and d == 0 and h >= 12)]
    slots = [x for x in slots if x[4] <= at(2, 12)]
    df = series(spark, slots, LONG)
    # Two days before the end: from noon of day 0 on, 49 slots of ``late`` and 37 of ``early``.
    plan = gates.submission_history_gate(df, 2, 2, 24)._jdf.queryExecution().executedPlan().toString()
    assert "date_trunc(hour" not in plan
    assert rows_of(gates.submission_history_gate(df, 2, 2, 24), "user_id") == [("late",)]


def test_losses_of_single_slots_meet_by_days(spark, history):
    """A profile is sent once a day and not once for each of its chunks, and groups of losses lie where they met."""
    rows, df = history
    m = measured(spark, random.Random(2))
    packed = profiles.pack(df, 60)
    got = profiles.chunk_losses(packed, m, 60, 60, scoring.observation_loss)
    want = scoring.series_losses(df, m, 60)
    tidy = lambda d: rows_of(d.withColumn("loss", F.round("loss", 6)), "resource_id", "user_id", "variable", "datetime", "loss", "n")
    assert tidy(got) == tidy(want)
    met = profiles.observed_chunks(m, 1440, 60).count()
    assert met == len({(r, d) for r in ("r1", "r2") for d in range(12)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = profiles.chunk_losses(packed, m, 60, 60, scoring.observation_loss)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_outliers_of_profiles_send_no_slots(spark, history):
    """Behind the one exchange of the rows, distances are taken where the profiles lie."""
    rows, df = history
    packed = profiles.pack(df.withColumn("value", F.col("value") + 2), 60)
    for measure in (outliers.dtw_distance, outliers.euclidean_distance):
        held = []

        def keep(frame, name):
            held.append(frame._jdf.queryExecution().executedPlan().toString())
            return stage(frame, name)

        got = measure(packed, outliers.median_profile(packed), keep)
        want = measure(df, outliers.median_profile(df), stage)
        shifted = lambda d: {tuple(r)[:3]: round(r["distance"], 9) for r in d.collect()}
        assert shifted(got) == shifted(want)
        assert not re.search(r"hashpartitioning\(challenge_id#\d+, variable#\d+, user_id", held[0])


def test_an_evaluation_builds_its_ensembles_once(spark, history, monkeypatch):
    """They are read twice, for the quantiles and for the interval."""
    from types import SimpleNamespace

    from quorumcast.catalog import score_queries

    rows, df = history
    m, held = measured(spark, random.Random(2)), []
    monkeypatch.setattr(score_queries, "stage", lambda d, name: held.append(name) or stage(d, name))
    got = score_queries.evaluate_strategies(SimpleNamespace(forecasts=lambda: df, measurements=lambda: m))
    assert held == ["ensembles"]
    assert rows_of(got.select("strategy", "variable").distinct(), "strategy", "variable") == [
        (s, v) for s in ("arithmetic_mean", "median") for v in ("interval", "q10", "q50", "q90")]
