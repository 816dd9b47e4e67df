"""Challenges, time grids, resampling: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumcast.catalog.ctes import cte, rnd, with_ctes
from quorumcast.catalog.registry import query
from quorumcast.functions.metrics import stable_round
from quorumcast.operators import grid
from quorumcast.plans import backtest

SLOT = 60

cte("resources_tz", "resources", """SELECT resource_id, user_id, use_case,
  CASE WHEN resource_id LIKE 'click%' OR resource_id LIKE 'view%' THEN 'Europe/Brussels' ELSE 'UTC' END AS timezone,
  CASE WHEN resource_id LIKE 'click%' OR resource_id LIKE 'view%' THEN 1 ELSE 0 END AS utc_offset FROM resources""")
# The data covers January, when Brussels is one hour ahead of UTC throughout.
cte("made_challenges", "sessions resources_tz", """SELECT resource_id || '_' || session_id AS challenge_id, session_id, launch_time,
  resource_id, user_id, use_case, target_day, CAST(target_day AS TIMESTAMP) - to_hours(utc_offset) AS start_datetime,
  CAST(target_day AS TIMESTAMP) - to_hours(utc_offset) + INTERVAL 23 HOUR AS end_datetime
  FROM (SELECT s.session_id, s.launch_time, r.*, CAST(CAST(s.launch_time + to_hours(utc_offset) AS DATE) + INTERVAL 1 DAY AS DATE) AS target_day
        FROM sessions s JOIN resources_tz r ON r.resource_id = s.resource_id)""")


def zoned_resources(t):
    brussels = F.col("resource_id").startswith("click") | F.col("resource_id").startswith("view")
    return t.resources().withColumn("timezone", F.when(brussels, "Europe/Brussels").otherwise("UTC"))


def event_series(t):
    """Single events as an irregular series of their resource."""
    return t.events.select(
        F.concat_ws("_", "event_type", F.floor(F.col("user_id") / 50)).alias("resource_id"),
        F.col("ts").cast("timestamp_ntz").alias("datetime"), "value",
    )


@query(with_ctes("made_challenges", "SELECT * FROM made_challenges"))
def make_challenges(t):
    return grid.make_challenges(t.sessions(), zoned_resources(t), SLOT)


@query(with_ctes("challenges forecasts", """SELECT c.challenge_id || '_' || f.user_id || '_' || f.variable AS submission_id,
  c.challenge_id, c.session_id, c.resource_id, f.user_id, f.variable, c.target_day
  FROM challenges c JOIN (SELECT DISTINCT resource_id, user_id, variable FROM forecasts) f ON f.resource_id = c.resource_id"""))
def make_submissions(t):
    return grid.make_submissions(t.challenges(), t.forecasts())


@query(with_ctes("challenges", """SELECT challenge_id, resource_id,
  unnest(generate_series(start_datetime, end_datetime, INTERVAL 1 HOUR)) AS datetime FROM challenges"""))
def forecast_grid(t):
    return grid.forecast_grid(t.challenges(), SLOT)


@query(with_ctes("challenges", """SELECT challenge_id, resource_id,
  date_diff('hour', start_datetime, end_datetime) + 1 AS expected_leadtimes FROM challenges"""))
def expected_leadtimes(t):
    return grid.expected_leadtimes(t.challenges(), SLOT)


cte("dataset_slots", "ev challenges", """SELECT e.resource_id, unnest(generate_series(date_trunc('hour', e.first + INTERVAL 30 MINUTE),
  c.last, INTERVAL 1 HOUR)) AS datetime FROM (SELECT resource_id, min(ts) AS first FROM ev GROUP BY 1) e
  JOIN (SELECT resource_id, max(end_datetime) AS last FROM challenges GROUP BY 1) c ON c.resource_id = e.resource_id""")


@query(with_ctes("dataset_slots measurements_raw", """SELECT g.resource_id, g.datetime, m.value FROM dataset_slots g
  LEFT JOIN measurements_raw m ON m.resource_id = g.resource_id AND m.datetime = g.datetime"""))
def dataset_grid_reindex(t):
    slots = grid.dataset_grid(event_series(t), t.challenges(), SLOT)
    return grid.reindex(slots, t.measurements_raw())


@query(with_ctes("dataset_slots ev", f"""SELECT g.resource_id, g.datetime, {rnd('m.value', 6)} AS value FROM dataset_slots g
  LEFT JOIN (SELECT resource_id, date_trunc('hour', ts) AS datetime, avg(CAST(cents AS DOUBLE) / 100) AS value FROM ev GROUP BY 1, 2) m
  ON m.resource_id = g.resource_id AND m.datetime = g.datetime"""))
def resample_mean(t):
    events = event_series(t)
    out = grid.reindex(grid.dataset_grid(events, t.challenges(), SLOT), grid.resample_mean(events, SLOT))
    return out.withColumn("value", stable_round(F.col("value"), 6))


cte("interp_pairs", "measurements_4h", """SELECT resource_id, datetime, value,
  lead(datetime) OVER w AS next_t, lead(value) OVER w AS next_v FROM measurements_4h
  WINDOW w AS (PARTITION BY resource_id ORDER BY datetime)""")
cte("interp", "interp_pairs", f"""SELECT resource_id, datetime + to_hours(CAST(i AS INTEGER)) AS datetime,
  {rnd("CASE WHEN i = 0 THEN value ELSE value + (next_v - value) * i / date_diff('hour', datetime, next_t) END", 6)} AS value
  FROM (SELECT *, unnest(generate_series(0, coalesce(date_diff('hour', datetime, next_t) - 1, 0))) AS i FROM interp_pairs)""")


@query(with_ctes("interp", "SELECT * FROM interp"))
def resample_interpolate(t):
    out = grid.resample_interpolate(t.measurements_raw(240), SLOT)
    return out.withColumn("value", stable_round(F.col("value"), 6))


cte("event_times", "ev", """SELECT resource_id, ts AS datetime, avg(CAST(cents AS DOUBLE) / 100) AS value FROM ev GROUP BY 1, 2""")
cte("event_pairs", "event_times", """SELECT resource_id, datetime, value, lead(datetime) OVER w AS next_t, lead(value) OVER w AS next_v FROM event_times
  WINDOW w AS (PARTITION BY resource_id ORDER BY datetime)""")
cte("event_slots", "event_pairs", """SELECT *, unnest(generate_series(date_trunc('hour', datetime - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR,
  coalesce(next_t - INTERVAL 1 MICROSECOND, datetime), INTERVAL 1 HOUR)) AS slot FROM event_pairs""")


@query(with_ctes("event_slots", f"""SELECT resource_id, slot AS datetime, {rnd("CASE WHEN slot = datetime THEN value ELSE value + (next_v - value) * date_diff('microsecond', datetime, slot) / date_diff('microsecond', datetime, next_t) END", 6)} AS value FROM event_slots"""))
def resample_interpolate_irregular(t):
    """Single events off the grid, at hours between them."""
    cents = event_series(t).withColumn("value", F.round(F.col("value") * 100) / 100)
    return grid.resample_interpolate(cents, SLOT).withColumn("value", stable_round(F.col("value"), 6))


@query(with_ctes("sessions measurements forecasts", f"""SELECT s.session_id, s.resource_id, m.n_measurements, m.sum_measurements,
  f.n_forecasts FROM sessions s
  JOIN (SELECT s.session_id, s.resource_id, count(*) AS n_measurements, {rnd('sum(m.value)', 6)} AS sum_measurements
    FROM sessions s JOIN measurements m ON m.resource_id = s.resource_id AND m.datetime <= s.launch_time GROUP BY 1, 2) m
    ON m.session_id = s.session_id AND m.resource_id = s.resource_id
  LEFT JOIN (SELECT s.session_id, s.resource_id, count(*) AS n_forecasts
    FROM sessions s JOIN forecasts f ON f.resource_id = s.resource_id AND f.datetime <= s.launch_time + INTERVAL 3 DAY GROUP BY 1, 2) f
    ON f.session_id = s.session_id AND f.resource_id = s.resource_id"""))
def history_cutoff(t):
    seen, given = grid.history_cutoff(t.measurements(), t.forecasts(), t.sessions(), horizon_days=3)
    keys = ["session_id", "resource_id"]
    m = seen.groupBy(*keys).agg(F.count("value").alias("n_measurements"), stable_round(F.sum("value"), 6).alias("sum_measurements"))
    return m.join(given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_forecasts")), keys, "left")


@query(with_ctes("grid forecasts", f"""SELECT g.resource_id, s.user_id, s.variable, count(*) AS n_slots, count(f.value) AS n_values,
  {rnd('sum(f.value)', 6)} AS total FROM grid g
  JOIN (SELECT DISTINCT resource_id, user_id, variable FROM forecasts) s ON s.resource_id = g.resource_id
  LEFT JOIN forecasts f ON f.resource_id = g.resource_id AND f.datetime = g.datetime AND f.user_id = s.user_id AND f.variable = s.variable
  GROUP BY 1, 2, 3"""))
def join_forecasters(t):
    dense = grid.join_forecasters(t.grid(), t.forecasts())
    return dense.groupBy("resource_id", "user_id", "variable").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count("value").alias("n_values"), stable_round(F.sum("value"), 6).alias("total")
    )


@query(with_ctes("challenges forecasts", f"""SELECT c.challenge_id, f.user_id, f.variable,
  count(CASE WHEN f.datetime < c.start_datetime THEN 1 END) AS n_train,
  count(CASE WHEN f.datetime >= c.start_datetime THEN 1 END) AS n_test, {rnd('sum(f.value)', 6)} AS total
  FROM challenges c JOIN forecasts f ON f.resource_id = c.resource_id AND f.datetime <= c.end_datetime GROUP BY 1, 2, 3"""))
def train_test_split(t):
    train, test = grid.train_test_split(t.forecasts(), t.challenges())
    rows = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rows.groupBy("challenge_id", "user_id", "variable").agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("part") == "test", 1)).alias("n_test"), stable_round(F.sum("value"), 6).alias("total"),
    )


@query(with_ctes("challenges measurements_raw", """SELECT c.challenge_id, m.resource_id, m.datetime, m.value FROM challenges c
  JOIN measurements_raw m ON m.resource_id = c.resource_id AND m.datetime BETWEEN c.start_datetime AND c.end_datetime"""))
def evaluation_slice(t):
    return grid.evaluation_slice(t.measurements_raw(), t.challenges()).select("challenge_id", "resource_id", "datetime", "value")


@query(with_ctes("measurements_raw forecasts", """SELECT m.* FROM measurements_raw m
  JOIN (SELECT resource_id, min(datetime) AS lo, max(datetime) AS hi FROM forecasts GROUP BY 1) f
  ON f.resource_id = m.resource_id AND m.datetime BETWEEN f.lo AND f.hi"""))
def measurement_period_alignment(t):
    return grid.measurement_period_alignment(t.measurements_raw(), t.forecasts())


cte("valid_range", "measurements_raw", """SELECT resource_id, min(datetime) + INTERVAL 8 DAY AS first_valid, max(datetime) - INTERVAL 1 DAY AS last_valid
  FROM measurements_raw GROUP BY 1 HAVING min(datetime) + INTERVAL 8 DAY < max(datetime) - INTERVAL 1 DAY""")
_LAUNCH = """SELECT 's_' || strftime(launch_time, '%Y-%m-%dT%H:%M') AS session_id, resource_id, launch_time FROM
  (SELECT resource_id, b + to_hours(CAST(i * {h} AS INTEGER)) AS launch_time FROM
    (SELECT resource_id, b, unnest(generate_series(0, n - 1)) AS i FROM ({plan})))"""


def _span(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


@query(with_ctes("valid_range", _LAUNCH.format(h=24, plan=f"""SELECT resource_id, b,
  greatest({_span('b', 'last_valid')} // 86400, 1) AS n FROM (SELECT *, date_trunc('day', first_valid) + INTERVAL 630 MINUTE AS b0,
  CASE WHEN date_trunc('day', first_valid) + INTERVAL 630 MINUTE < first_valid THEN date_trunc('day', first_valid) + INTERVAL 630 MINUTE
  ELSE date_trunc('day', first_valid) + INTERVAL 630 MINUTE END AS b FROM valid_range)""")))
def backtest_schedule(t):
    return backtest.backtest_schedule(t.measurements_raw())


@query(with_ctes("valid_range", _LAUNCH.format(h=12, plan=f"""SELECT resource_id, b,
  CASE WHEN TIMESTAMP '2024-01-31 10:30:00' > last_valid THEN greatest({_span('b', 'last_valid')} // 43200, 1) ELSE 49 END AS n
  FROM (SELECT *, CASE WHEN TIMESTAMP '2024-01-07 10:30:00' < first_valid THEN date_trunc('day', first_valid) + INTERVAL 630 MINUTE
    ELSE TIMESTAMP '2024-01-07 10:30:00' END AS b FROM valid_range)""")))
def backtest_schedule_start_end(t):
    return backtest.backtest_schedule(t.measurements_raw(), "2024-01-07 10:30:00", "2024-01-31 10:30:00", freq_hours=12)
