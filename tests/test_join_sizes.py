import pytest
from pyspark.sql import functions as F

from quorumcast import staging
from quorumcast.sources.event_bridge import EventTables

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_days_and_forecasts_of_a_small_file_are_not_planned_as_broadcasts(spark, tmp_path):
    """Their estimate is the size of the file, however many rows they unpack to; only a measured size may send them through the driver."""
    rows = [(i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", i % 120, "click", float(i)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    before = {k: spark.conf.get(k, None) for k in (PLANNED, MEASURED)}
    try:
        spark.conf.set(PLANNED, "10485760b")
        spark.conf.unset(MEASURED)
        t = EventTables(spark, str(tmp_path))
        joined = t.forecasts().join(t.challenges().select("challenge_id", "target_day"), "challenge_id")
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert spark.conf.get(MEASURED) == "10485760b"
        EventTables(spark, str(tmp_path))  # a second one keeps the limit
        assert spark.conf.get(MEASURED) == "10485760b"
        assert joined.count() == t.forecasts().count() > 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", i % 120, "click", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    names = (PLANNED, MEASURED, PARTITIONS)
    before = {k: spark.conf.get(k, None) for k in names}
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.mark.parametrize("name", ["grid", "challenges", "sessions", "participation"])
def test_what_an_explode_leaves_is_measured_before_a_join(spark, events, name):
    spark.conf.set(PLANNED, "-1")
    spark.conf.set(MEASURED, "700")
    t = EventTables(spark, events)
    other = spark.createDataFrame([(f"click_{i % 3}", i) for i in range(2000)], "resource_id string, x int").repartition(3)
    joined = getattr(t, name)().join(other, "resource_id")
    assert joined.collect()
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_input(spark, events, monkeypatch):
    EventTables(spark, events)
    assert spark.conf.get(PARTITIONS, None) is None
    monkeypatch.setattr(staging, "INPUT_PER_PARTITION", 100)
    EventTables(spark, events)
    many = int(spark.conf.get(PARTITIONS))
    assert many > 20
    monkeypatch.setattr(staging, "INPUT_PER_PARTITION", 200)
    EventTables(spark, events)  # never fewer than are set
    assert int(spark.conf.get(PARTITIONS)) == many
