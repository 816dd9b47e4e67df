import os

import pytest

import __spark_entry__ as entry
from quorumcast.catalog import registry

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(entry.queries()) >= set(entry.oracle_sql())
    assert len(entry.queries()) > 100


def test_entry(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    df = entry.entry(spark)
    assert df.columns == ["resource_id", "challenge_id", "user_id", "variable", "metric", "value"]
    assert df.count() > 0


def test_results_do_not_depend_on_partitions(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    seen = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, entry.queries()["league_assignment"](spark, FOLDER).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_events_of_another_month_reach_the_results(spark, tmp_path):
    """The days of the tables are those of the events, in code and in SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"2023-06-{10 + i % 9:02d} {i * 7 % 24:02d}:15:00", i % 60, ("click", "view")[i % 2], 1.0 + i % 13) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("skill_scores", "session_summary"):
        df = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(registry.oracle_sql()[name])
        at = [[d[0] for d in want.description].index(c) for c in df.columns]
        got = sorted(map(tuple, df.collect()), key=str)
        assert got and got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert all("2023-06-" in r.challenge_id for r in registry.queries()["skill_scores"](spark, str(tmp_path)).select("challenge_id").distinct().collect())
