"""Scans, sinks and file formats: registered queries.

Sink queries write to the staging folder and return what a reader finds there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorumcast.catalog.ctes import cte, rnd, with_ctes
from quorumcast.catalog.ensemble_queries import rounded
from quorumcast.catalog.grid_queries import event_series
from quorumcast.catalog.kpi_queries import scores as score_table
from quorumcast.catalog.registry import query
from quorumcast.catalog.score_queries import two_ensembles
from quorumcast.functions.metrics import stable_round
from quorumcast.functions.timegrid import slot_start
from quorumcast.operators import kpi
from quorumcast.sources import readers, sinks
from quorumcast.staging import staging_path

FIRST, LAST = "2024-01-08", "2024-01-21"
T0, T1 = "2024-01-08 00:00:00", "2024-01-21 23:00:00"
_T = f"datetime BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}'"
_D = f"target_day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
HEADER = "challenge_id || '_' || user_id || '_' || variable"

cte("sub_forecasts", "forecasts", f"""SELECT {HEADER} AS submission_id, resource_id, challenge_id, user_id, variable, datetime, value,
  CAST(datetime AS DATE) AS target_day FROM forecasts""")


@query(f"""SELECT event_type || '_' || CAST(user_id // 50 AS VARCHAR) AS resource_id, date_trunc('hour', ts) AS datetime, min(value) AS value
  FROM events WHERE ts >= TIMESTAMP '{T0}' AND ts < TIMESTAMP '2024-01-22 00:00:00' AND event_type <> 'signup' GROUP BY 1, 2""")
def scan_measurements(t):
    repeated = event_series(t).withColumn("datetime", slot_start(F.col("datetime"), 60))
    return readers.scan_measurements(repeated, T0, T1, t.resources().filter("is_active"))


@query(with_ctes("forecasts", f"SELECT resource_id, user_id, variable, datetime, value FROM forecasts WHERE {_T} AND user_id <> 'f03'"))
def scan_forecast_history(t):
    """Every tenth day was submitted a second time with a later id; the first one counts."""
    headers, rows = t.submissions(), t.submission_forecasts()
    again = F.concat(F.col("submission_id"), F.lit("_2"))
    all_headers = headers.unionByName(headers.withColumn("submission_id", again))
    second = rows.filter(F.dayofmonth("datetime") % 10 == 0).select(again.alias("submission_id"), "datetime", (F.col("value") + 1).alias("value"))
    wanted = headers.filter(F.col("user_id") != "f03").select("resource_id", "user_id", "variable")
    return readers.scan_forecast_history(rows.unionByName(second), all_headers, t.challenges(), T0, T1, wanted)


@query(with_ctes("submissions", f"SELECT submission_id, challenge_id, user_id, variable, resource_id, target_day FROM submissions WHERE {_D}"))
def scan_submissions(t):
    return readers.scan_submissions(t.submissions(), t.challenges(), FIRST, LAST)


@query(with_ctes("sub_forecasts", f"SELECT challenge_id, resource_id, submission_id, user_id, variable, datetime, value FROM sub_forecasts WHERE {_D}"))
def challenge_submission_forecasts(t):
    work = t.challenges().filter(F.col("target_day").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))
    return readers.challenge_submission_forecasts(t.submission_forecasts(), t.submissions(), t.challenges(), work)


@query(with_ctes("challenges scores", """SELECT challenge_id, resource_id, target_day FROM challenges c WHERE target_day >= DATE '2024-01-08'
  AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.challenge_id = c.challenge_id AND extract(day FROM s.target_day) % 3 <> 0)"""))
def unscored_challenges(t):
    done = score_table(t).filter(F.dayofmonth("target_day") % 3 != 0)
    return readers.unscored_challenges(t.challenges(), done, FIRST).select("challenge_id", "resource_id", "target_day")


@query(with_ctes("challenges", """SELECT DISTINCT target_day, CASE WHEN extract(day FROM target_day) <= 2
  THEN CAST(date_trunc('month', target_day - INTERVAL 1 MONTH) AS DATE) ELSE CAST(date_trunc('month', target_day) AS DATE) END AS start_day FROM challenges"""))
def recalc_window(t):
    return t.challenges().select("target_day").distinct().withColumn("start_day", readers.recalc_start(F.col("target_day")))


@query(with_ctes("ensemble_two", f"SELECT strategy AS user_id, resource_id, challenge_id, variable, datetime, {rnd('value', 6)} AS value FROM ensemble_two WHERE strategy = 'median'"))
def challenge_ensemble_forecasts(t):
    return rounded(readers.challenge_ensemble_forecasts(two_ensembles(t), ["median"], t.challenges()))


@query(with_ctes("continuous_forecasts", f"SELECT * FROM continuous_forecasts WHERE {_T} AND user_id <> 'f10'"))
def scan_continuous_forecasts(t):
    wanted = t.participation().filter(F.col("user_id") != "f10")
    return readers.scan_continuous_forecasts(t.continuous_forecasts(), T0, T1, wanted)


@query(with_ctes("scores participation", f"""SELECT s.challenge_id, s.user_id, s.variable, s.metric, s.value, s.resource_id, s.target_day, p.is_fixed_payment
  FROM scores s JOIN participation p ON p.resource_id = s.resource_id AND p.user_id = s.user_id
  WHERE s.metric = 'rmse' AND s.{_D} AND NOT p.is_fixed_payment"""))
def scan_scores(t):
    return readers.scan_scores(score_table(t), t.challenges(), t.participation(), FIRST, LAST, ["rmse"])


@query(with_ctes("ensemble_two challenges", """SELECT challenge_id, resource_id, target_day FROM challenges WHERE challenge_id IN (SELECT challenge_id FROM ensemble_two)"""))
def ensemble_runs(t):
    return readers.ensemble_runs(two_ensembles(t), t.challenges())


@query(with_ctes("sub_forecasts", f"SELECT resource_id, target_day, user_id, variable, datetime, value FROM sub_forecasts WHERE {_D}"))
def forecasts_by_target_day(t):
    return readers.forecasts_by_target_day(t.submission_forecasts(), t.submissions(), t.challenges(), FIRST, LAST)


@query(with_ctes("participation", "SELECT * FROM participation"))
def participation_types(t):
    return readers.participation_types(t.participation())


@query(with_ctes("resources", "SELECT * FROM resources"))
def resource_dim(t):
    return readers.resource_dim(t.resources())


SERIES = [f"f{k:02d}_{q}" for k in range(1, 16) for q in ("q10", "q50", "q90")]


def wide_csv(t):
    path = staging_path(t.spark, "wide")
    rows = t.forecasts().select("resource_id", "datetime", "user_id", "variable", "value").repartition("resource_id", "datetime")
    wide = readers.pivot_forecasts(rows, ["resource_id", "datetime"], F.concat_ws("_", "user_id", "variable"), SERIES)
    # Repeated times with other values: at five o'clock larger ones, at seven one value is empty.
    higher = wide.filter(F.hour("datetime") == 5).select("resource_id", "datetime", *[(F.col(c) + 1).alias(c) for c in SERIES])
    emptier = wide.filter(F.hour("datetime") == 7).withColumn("f01_q10", F.lit(None).cast("double"))
    wide = wide.unionByName(higher).unionByName(emptier)
    wide.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm")).write.option("header", True).option("compression", "gzip").csv(path)
    return path


@query(with_ctes("forecasts", f"""SELECT resource_id, user_id, variable, datetime, {rnd('value', 6)} AS value FROM forecasts
  WHERE NOT (extract(hour FROM datetime) = 7 AND user_id = 'f01' AND variable = 'q10')"""))
def read_wide_dataset(t):
    """Forecasts written as a wide CSV with repeated, conflicting times, read back and turned into rows."""
    wide = readers.read_wide_dataset(t.spark, wide_csv(t), SERIES, keys=["resource_id"])
    return rounded(readers.unpivot_forecasts(wide, F.col("resource_id")))


@query(with_ctes("measurements_raw", """SELECT resource_id, datetime, CASE WHEN extract(hour FROM datetime) <> 3 THEN value END AS value FROM measurements_raw
  UNION ALL SELECT resource_id, datetime, value FROM measurements_raw"""))
def append_table(t):
    path = staging_path(t.spark, "append")
    raw = t.measurements_raw()
    nan = F.when(F.hour("datetime") == 3, F.lit(float("nan"))).otherwise(F.col("value"))
    sinks.append_table(raw.withColumn("value", nan), path)
    sinks.append_table(raw, path)
    return t.spark.read.parquet(path)


@query(with_ctes("scores", """SELECT 'backup' AS part, challenge_id, user_id, variable, metric, value, target_day FROM scores WHERE metric IN ('rmse', 'winkler') AND target_day <= DATE '2024-01-20'
  UNION ALL SELECT 'kept', challenge_id, user_id, variable, metric, value, target_day FROM scores WHERE metric IN ('rmse', 'winkler') AND target_day > DATE '2024-01-20'"""))
def backup_and_purge_scores(t):
    spark, today = t.spark, "2024-01-20"
    table = f"scores_{uuid.uuid4().hex[:12]}"
    columns = ["challenge_id", "user_id", "variable", "metric", "value", "target_day"]
    path = staging_path(spark, "scores")
    score_table(t).select(*columns).write.partitionBy("target_day").format("parquet").option("path", path).saveAsTable(table)
    stored = spark.table(table)
    copy = staging_path(spark, "score-backup")
    sinks.backup_scores(stored, today, copy)
    sinks.purge_scores(spark, table, today)
    spark.sql(f"DROP TABLE {table}")
    schema = "challenge_id string, user_id string, variable string, metric string, value double, target_day date"
    saved = spark.read.schema(schema).option("header", True).csv(copy)
    return saved.withColumn("part", F.lit("backup")).unionByName(
        spark.read.schema(schema).parquet(path).withColumn("part", F.lit("kept")))  # the files, not the table


_WIDE = ", ".join(rnd(f"max(CASE WHEN f.user_id = '{c[:3]}' AND f.variable = '{c[4:]}' THEN f.value END)", 6) + f" AS {c}" for c in SERIES)


@query(with_ctes("forecasts challenges measurements", f"""SELECT c.use_case, c.target_day, f.datetime, f.resource_id, {rnd('any_value(m.value)', 6)} AS target, {_WIDE}
  FROM forecasts f JOIN challenges c ON c.challenge_id = f.challenge_id
  LEFT JOIN measurements m ON m.resource_id = f.resource_id AND m.datetime = f.datetime GROUP BY 1, 2, 3, 4"""))
def export_training_data(t):
    path = staging_path(t.spark, "training")
    users = [f"f{k:02d}" for k in range(1, 16)]
    sinks.export_training_data(t.forecasts(), t.measurements(), t.challenges(), users, path, slot_minutes=60, compression="gzip")
    fields = "resource_id string, datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in SERIES) + ", target double, use_case string, target_day date"
    back = t.spark.read.schema(fields).option("header", True).csv(path)
    return back.select("use_case", "target_day", "datetime", "resource_id", *[stable_round(F.col(c), 6).alias(c) for c in ("target", *SERIES)])


_CSV_TIME = "strftime({}, '%Y-%m-%d %H:%M')"
cte("backtest_parts", "sessions challenges ensemble_two forecasts", f"""SELECT 'sessions' AS part, s.session_id, s.resource_id, CAST(n AS VARCHAR) AS name,
    {_CSV_TIME.format('s.launch_time')} || ' ' || {_CSV_TIME.format('c.start_datetime')} || ' ' || CAST(CAST(c.end_datetime AS DATE) AS VARCHAR) AS variable,
    {_CSV_TIME.format('c.end_datetime')} AS datetime, CAST(NULL AS DOUBLE) AS value
    FROM sessions s JOIN challenges c ON c.session_id = s.session_id AND c.resource_id = s.resource_id
    LEFT JOIN (SELECT resource_id, count(DISTINCT user_id) AS n FROM forecasts GROUP BY 1) f ON f.resource_id = s.resource_id
  UNION ALL SELECT 'forecasts', c.session_id, e.resource_id, e.strategy, e.variable, {_CSV_TIME.format('e.datetime')}, {rnd('e.value', 6)}
    FROM ensemble_two e JOIN challenges c ON c.challenge_id = e.challenge_id
  UNION ALL SELECT 'submissions', c.session_id, f.resource_id, f.user_id, f.variable, {_CSV_TIME.format('f.datetime')}, {rnd('f.value', 6)}
    FROM forecasts f JOIN challenges c ON c.challenge_id = f.challenge_id""")


@query(with_ctes("backtest_parts", "SELECT * FROM backtest_parts"))
def write_backtest_reports(t):
    """All rows of the three reports, read back."""
    path = staging_path(t.spark, "backtest")
    sinks.write_backtest_reports(t.sessions(), t.challenges(), two_ensembles(t), t.forecasts(), path, compression="gzip")
    read = lambda part, schema: t.spark.read.schema(schema).option("header", True).csv(f"{path}/{part}").withColumn("part", F.lit(part))
    head = read("sessions", "session_id string, resource_id string, launch_time string, target_day string, forecast_start string, forecast_end string, n_forecasters string")
    out = head.select("part", "session_id", "resource_id", F.col("n_forecasters").alias("name"),
                      F.concat_ws(" ", "launch_time", "forecast_start", "target_day").alias("variable"),
                      F.col("forecast_end").alias("datetime"), F.lit(None).cast("double").alias("value"))
    for part, name in (("forecasts", "strategy"), ("submissions", "forecaster_id")):
        rows = read(part, f"session_id string, resource_id string, {name} string, variable string, datetime string, value double")
        out = out.unionByName(rounded(rows.withColumnRenamed(name, "name")))
    return out


@query(with_ctes("measurements_raw resources", f"""SELECT 'measurements' AS tbl, 's1' AS session_id, resource_id, datetime, {rnd('value', 6)} AS value FROM measurements_raw
  UNION ALL SELECT 'resources', 's1', resource_id, CAST(NULL AS TIMESTAMP), NULL FROM resources"""))
def snapshot_inputs(t):
    path = staging_path(t.spark, "snapshot")
    sinks.snapshot_inputs({"measurements": t.measurements_raw(), "resources": t.resources()}, "s1", path)
    columns = ["tbl", "session_id", "resource_id", "datetime", "value"]
    first = rounded(t.spark.read.parquet(f"{path}/measurements").withColumn("tbl", F.lit("measurements"))).select(*columns)
    second = t.spark.read.parquet(f"{path}/resources").withColumn("tbl", F.lit("resources"))
    return first.unionByName(second.select("tbl", "session_id", "resource_id", F.lit(None).cast("timestamp_ntz").alias("datetime"), F.lit(None).cast("double").alias("value")))


@query(with_ctes("ensemble_two", f"SELECT challenge_id, strategy, variable, strftime(datetime, '%Y-%m-%dT%H:%M:%SZ') AS datetime, {rnd('value', 6)} AS value FROM ensemble_two"))
def publish_forecasts(t):
    """The JSON lists, parsed again."""
    records = sinks.publish_forecasts(two_ensembles(t))
    parsed = F.from_json("forecasts", "array<struct<datetime: string, value: double>>")
    return records.select("challenge_id", "strategy", "variable", F.inline(parsed))


@query(with_ctes("tracked_all", f"""SELECT resource_id, track, 2024 AS year, 1 AS month_no, user_id, avg_score FROM
  (SELECT resource_id, track, user_id, {rnd('avg(value)', 6)} + CASE WHEN resource_id LIKE 'view%' THEN 1 ELSE 0 END AS avg_score FROM tracked_all GROUP BY 1, 2, 3)"""))
def publish_monthly_stats(t):
    """All resources are published, then those of one type again with other values."""
    path = staging_path(t.spark, "monthly")
    stats = kpi.track_scores(score_table(t)).groupBy("resource_id", "track", "month", "user_id").agg(stable_round(F.avg("value"), 6).alias("avg_score"))
    sinks.publish_monthly_stats(stats, path)
    changed = stats.filter(F.col("resource_id").startswith("view")).withColumn("avg_score", F.col("avg_score") + 1)
    sinks.publish_monthly_stats(changed, path)
    return t.spark.read.parquet(path).drop("bucket")
