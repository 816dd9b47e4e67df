"""Eligibility and validation: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumcast.catalog.ctes import cte, with_ctes
from quorumcast.catalog.grid_queries import SLOT
from quorumcast.catalog.registry import query
from quorumcast.operators import gates, grid

cte("complete_users", "forecasts_gappy challenges", """SELECT f.challenge_id, f.user_id FROM
  (SELECT challenge_id, user_id, count(CASE WHEN variable = 'q10' THEN value END) AS a,
    count(CASE WHEN variable = 'q50' THEN value END) AS b, count(CASE WHEN variable = 'q90' THEN value END) AS c
   FROM forecasts_gappy GROUP BY 1, 2) f
  JOIN challenges k ON k.challenge_id = f.challenge_id
  WHERE a = 24 AND b = 24 AND c = 24""")
cte("complete_normal", "submissions_gappy", """SELECT challenge_id, user_id FROM submissions_gappy GROUP BY 1, 2
  HAVING string_agg(variable, ',' ORDER BY variable) = 'q10,q50,q90'""")


@query(with_ctes("challenges forecasts", """SELECT challenge_id, resource_id, target_day FROM challenges c
  WHERE EXISTS (SELECT 1 FROM forecasts f WHERE f.challenge_id = c.challenge_id)"""))
def drop_empty_challenges(t):
    return gates.drop_empty_challenges(t.challenges(), t.submissions()).select("challenge_id", "resource_id", "target_day")


_HISTORY = """SELECT resource_id, user_id, min(n) >= 144 AS ok FROM
  (SELECT f.resource_id, f.user_id, f.variable, count(CASE WHEN f.datetime >= l.last - INTERVAL 7 DAY THEN f.value END) AS n
   FROM forecasts_gappy f JOIN (SELECT resource_id, user_id, variable, max(datetime) AS last FROM forecasts_gappy GROUP BY 1, 2, 3) l
     ON l.resource_id = f.resource_id AND l.user_id = f.user_id AND l.variable = f.variable GROUP BY 1, 2, 3) GROUP BY 1, 2"""
cte("history_ok", "forecasts_gappy", _HISTORY)


@query(with_ctes("history_ok", """SELECT resource_id, user_id FROM
  (SELECT *, bool_or(ok) OVER (PARTITION BY resource_id) AS any_ok FROM history_ok) WHERE ok OR NOT any_ok"""))
def submission_history_gate(t):
    return gates.submission_history_gate(t.forecasts_gappy(), slots_per_day=24)


@query(with_ctes("history_ok", """SELECT resource_id, user_id FROM
  (SELECT *, bool_or(ok) OVER () AS any_ok FROM history_ok) WHERE ok OR NOT any_ok"""))
def submission_history_gate_global(t):
    return gates.submission_history_gate(t.forecasts_gappy(), slots_per_day=24, guard="global")


@query(with_ctes("complete_users", "SELECT * FROM complete_users"))
def complete_quantile_forecasters(t):
    return gates.complete_quantile_forecasters(t.forecasts_gappy(), t.challenges(), slot_minutes=SLOT)


@query(with_ctes("forecasts_gappy complete_users challenges", """SELECT resource_id, user_id, variable, count(value) AS n_samples
  FROM forecasts_gappy f WHERE EXISTS (SELECT 1 FROM complete_users u JOIN challenges c ON c.challenge_id = u.challenge_id
    WHERE c.resource_id = f.resource_id AND u.user_id = f.user_id)
  GROUP BY 1, 2, 3 HAVING count(value) >= 480"""))
def forecasters_with_history(t):
    f = t.forecasts_gappy()
    valid = gates.complete_quantile_forecasters(f, t.challenges(), slot_minutes=SLOT)
    per_resource = valid.join(t.challenges().select("challenge_id", "resource_id"), "challenge_id")
    return gates.forecasters_with_history(f, per_resource, min_samples=480)


_C5 = """SELECT c.challenge_id, count(*) AS expected, count(m.value) AS available, count(*) = count(m.value) AS is_complete
  FROM (SELECT challenge_id, resource_id, unnest(generate_series(start_datetime, end_datetime, INTERVAL 4 HOUR)) AS datetime FROM challenges) c
  LEFT JOIN measurements_4h m ON m.resource_id = c.resource_id AND m.datetime = c.datetime GROUP BY 1"""
cte("completeness_4h", "challenges measurements_4h", _C5)


@query(with_ctes("completeness_4h", "SELECT * FROM completeness_4h"))
def measurement_completeness(t):
    return gates.measurement_completeness(t.challenges(), t.measurements_raw(240), 240)


@query(with_ctes("completeness_4h challenges", """SELECT challenge_id, resource_id FROM challenges
  WHERE challenge_id IN (SELECT challenge_id FROM completeness_4h WHERE is_complete)"""))
def measurement_completeness_gate(t):
    return gates.measurement_completeness_gate(t.challenges(), t.measurements_raw(240), 240).select("challenge_id", "resource_id")


@query(with_ctes("complete_normal", "SELECT * FROM complete_normal"))
def complete_normal_submitters(t):
    return gates.complete_normal_submitters(t.submissions(t.forecasts_gappy()))


cte("filled_rows", "continuous_forecasts challenges complete_normal", """SELECT c.resource_id, c.challenge_id, f.user_id, f.variable, f.datetime, f.value
  FROM continuous_forecasts f JOIN challenges c ON c.resource_id = f.resource_id AND f.datetime BETWEEN c.start_datetime AND c.end_datetime
  WHERE NOT EXISTS (SELECT 1 FROM complete_normal n WHERE n.challenge_id = c.challenge_id AND n.user_id = f.user_id)""")


@query(with_ctes("filled_rows", """SELECT r.*, 'continuous' AS submission_type FROM filled_rows r JOIN
  (SELECT challenge_id, user_id FROM filled_rows GROUP BY 1, 2
   HAVING count(CASE WHEN variable = 'q10' THEN value END) = 24 AND count(CASE WHEN variable = 'q50' THEN value END) = 24
      AND count(CASE WHEN variable = 'q90' THEN value END) = 24 AND count(*) = 72) k
  ON k.challenge_id = r.challenge_id AND k.user_id = r.user_id"""))
def fill_from_continuous(t):
    return gates.fill_from_continuous(t.challenges(), t.continuous_forecasts(), t.submissions(t.forecasts_gappy()), slot_minutes=SLOT)


@query(with_ctes("forecasts_gappy complete_users", """SELECT f.challenge_id, f.user_id, f.variable, f.datetime, f.value FROM forecasts_gappy f
  JOIN complete_users u ON u.challenge_id = f.challenge_id AND u.user_id = f.user_id"""))
def restrict_to_valid(t):
    f = t.forecasts_gappy()
    valid = gates.complete_quantile_forecasters(f, t.challenges(), slot_minutes=SLOT)
    return gates.restrict_to_valid(f, valid).select("challenge_id", "user_id", "variable", "datetime", "value")


@query(with_ctes("resources", "SELECT * FROM resources WHERE is_active"))
def active_resources(t):
    return gates.active_resources(t.resources())


@query(with_ctes("submissions_gappy", """SELECT challenge_id, user_id, string_agg(variable, ',' ORDER BY variable) AS variables
  FROM submissions_gappy GROUP BY 1, 2"""))
def session_summary(t):
    return gates.session_summary(t.submissions(t.forecasts_gappy()))


@query(with_ctes("submissions challenges", """SELECT c.session_id, c.challenge_id, s.user_id, c.resource_id, s.variable
  FROM submissions s JOIN challenges c ON c.challenge_id = s.challenge_id"""))
def session_manifest(t):
    return gates.session_manifest(t.challenges(), t.submissions())


_CHECKS = [
    ("timezone_given", "CASE WHEN tz IS NULL THEN 'error' ELSE 'ok' END", "NULL"), ("use_case_given", "CASE WHEN uc IS NULL THEN 'error' ELSE 'ok' END", "NULL"),
    ("use_case_known", "CASE WHEN uc IN ('wind_power', 'solar_power', 'load') THEN 'ok' ELSE 'warning' END", "NULL"),
    ("target_present", "CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END", "n"), ("datetime_column", "'ok'", "NULL"),
    ("column_naming", "'warning'", "1"), ("forecast_columns", "'ok'", "45"),
    ("date_range", "CASE WHEN lo + INTERVAL 8 DAY < hi - INTERVAL 1 DAY THEN 'ok' ELSE 'error' END", "date_diff('day', lo, hi)"),
    ("missing_rate", "CASE WHEN pct <= 10 OR pct IS NULL THEN 'ok' ELSE 'warning' END", "pct"),
]


@query(with_ctes("grid measurements_raw resources", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT resource_id, '{n}' AS \"check\", {level} AS level, CAST({detail} AS DOUBLE) AS detail FROM q" for n, level, detail in _CHECKS
) + ")").replace("\nSELECT * FROM (", """, q AS (SELECT g.resource_id, min(g.datetime) AS lo, max(g.datetime) AS hi, count(*) AS n,
  round(CAST(count(*) - count(m.value) AS DOUBLE) / count(*) * 100, 1) AS pct, 'UTC' AS tz, 'load' AS uc FROM grid g
  LEFT JOIN measurements_raw m ON m.resource_id = g.resource_id AND m.datetime = g.datetime GROUP BY 1
  UNION ALL SELECT 'no_zone_' || resource_id, NULL, NULL, NULL, NULL, NULL, use_case FROM resources
  UNION ALL SELECT 'no_use_' || resource_id, NULL, NULL, NULL, NULL, 'UTC', NULL FROM resources
  UNION ALL SELECT 'odd_use_' || resource_id, NULL, NULL, NULL, NULL, 'UTC', 'tidal' FROM resources)
SELECT * FROM (""", 1))
def validate_dataset(t):
    columns = ["datetime", "note"] + [f"f{k:02d}_{q}" for k in range(1, 16) for q in ("q10", "q50", "q90")]
    series = grid.reindex(t.grid().select("resource_id", "datetime"), t.measurements_raw())
    r = t.resources()
    # Resources that fail: without a zone, without a use case, with an unknown one, and none has a target.
    none = F.lit(None).cast("string")
    bad = (
        r.withColumn("resource_id", F.concat(F.lit("no_zone_"), "resource_id")).withColumn("timezone", none)
        .unionByName(r.withColumn("resource_id", F.concat(F.lit("no_use_"), "resource_id")).withColumn("use_case", none))
        .unionByName(r.withColumn("resource_id", F.concat(F.lit("odd_use_"), "resource_id")).withColumn("use_case", F.lit("tidal")))
    )
    return gates.validate_dataset(series, columns, r.unionByName(bad))
