"""The derived tables restated as ANSI SQL common table expressions."""

from __future__ import annotations

_D = "CAST({} AS DOUBLE)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql)


def with_ctes(names: str, body: str) -> str:
    """``WITH`` the named tables and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def rnd(expr: str, digits: int = 3) -> str:
    """Round half-up after cutting noise beyond the 9th decimal."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(30,9)), {digits}) AS DOUBLE)"


def cday(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


cte("ev", "", """SELECT event_type || '_' || CAST(user_id // 50 AS VARCHAR) AS resource_id, ts,
  CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value IS NOT NULL""")
cte("measurements_raw", "ev", """SELECT resource_id, date_trunc('hour', ts) AS datetime,
  CAST(sum(cents) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value FROM ev GROUP BY 1, 2""")
cte("measurements_4h", "ev", """SELECT resource_id, date_trunc('day', ts) + to_hours(4 * CAST(extract(hour FROM ts) // 4 AS INTEGER)) AS datetime,
  CAST(sum(cents) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value FROM ev GROUP BY 1, 2""")
cte("fill", "measurements_raw", f"""SELECT resource_id, {rnd('avg(value)', 4)} AS fill_value FROM measurements_raw GROUP BY 1""")
cte("span", "", """SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS first_slot, CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 23 HOUR AS last_slot,
  CAST(date_trunc('day', max(ts)) AS TIMESTAMP) AS last_day FROM events WHERE value IS NOT NULL""")
cte("grid", "fill span", """SELECT resource_id, fill_value, unnest(generate_series((SELECT first_slot FROM span),
  (SELECT last_slot FROM span), INTERVAL 1 HOUR)) AS datetime FROM fill""")
cte("measurements", "grid measurements_raw", """SELECT g.resource_id, g.datetime, coalesce(m.value, g.fill_value) AS value
  FROM grid g LEFT JOIN measurements_raw m ON m.resource_id = g.resource_id AND m.datetime = g.datetime""")
cte("resources", "measurements_raw", """SELECT DISTINCT resource_id, 'owner_' || resource_id AS user_id, 'UTC' AS timezone,
  CASE WHEN resource_id LIKE 'click%' THEN 'wind_power' WHEN resource_id LIKE 'view%' THEN 'solar_power' ELSE 'load' END AS use_case,
  resource_id NOT LIKE 'signup%' AS is_active FROM measurements_raw""")
cte("lagged", "measurements span", """SELECT m.resource_id, k.k, 'f' || lpad(CAST(k.k AS VARCHAR), 2, '0') AS user_id,
  m.datetime + to_hours(CAST(24 + 3 * k.k AS INTEGER)) AS datetime, m.value AS mid
  FROM measurements m CROSS JOIN (SELECT unnest(generate_series(1, 15)) AS k) k
  WHERE m.datetime + to_hours(CAST(24 + 3 * k.k AS INTEGER)) <= (SELECT last_slot FROM span)""")
_QUANT = """SELECT resource_id, user_id, k, datetime, 'q10' AS variable,
    mid * (CAST(0.4 AS DOUBLE) + CAST(0.02 AS DOUBLE) * k) AS value FROM lagged
  UNION ALL SELECT resource_id, user_id, k, datetime, 'q50', mid FROM lagged
  UNION ALL SELECT resource_id, user_id, k, datetime, 'q90',
    mid * (CAST(1.8 AS DOUBLE) - CAST(0.02 AS DOUBLE) * k) FROM lagged"""
cte("quantiles", "lagged", _QUANT)
_KEEP = "NOT ((extract(day FROM datetime) * 7 + 3 * k) % 17 < CASE WHEN k > 12 THEN 5 ELSE 1 END)"
cte("forecasts", "quantiles", f"""SELECT resource_id, resource_id || '_' || {cday('datetime')} AS challenge_id,
  user_id, variable, datetime, value FROM quantiles WHERE {_KEEP}""")
cte("forecasts_gappy", "quantiles", f"""SELECT resource_id, resource_id || '_' || {cday('datetime')} AS challenge_id,
  user_id, variable, datetime,
  CASE WHEN NOT (extract(hour FROM datetime) = k AND extract(day FROM datetime) % 9 = k % 9) THEN value END AS value
  FROM quantiles WHERE {_KEEP} AND NOT (variable = 'q90' AND (extract(day FROM datetime) + k) % 11 = 0)""")
cte("continuous_forecasts", "quantiles", """SELECT user_id, resource_id, datetime, variable, value FROM quantiles
  WHERE k >= 10 AND NOT ((k = 11 AND variable = 'q90' AND extract(day FROM datetime) % 3 = 0)
   OR (k = 12 AND extract(hour FROM datetime) = 5 AND extract(day FROM datetime) % 5 = 0))""")
cte("challenges", "resources span", """SELECT resource_id || '_' || strftime(target_day, '%Y-%m-%d') AS challenge_id,
  's_' || strftime(target_day, '%Y-%m-%d') AS session_id, resource_id, use_case, target_day,
  CAST(target_day AS TIMESTAMP) AS start_datetime, CAST(target_day AS TIMESTAMP) + INTERVAL 23 HOUR AS end_datetime
  FROM (SELECT *, CAST(unnest(generate_series((SELECT first_slot FROM span), (SELECT last_day FROM span), INTERVAL 1 DAY)) AS DATE) AS target_day
        FROM resources)""")
cte("sessions", "challenges", """SELECT session_id, resource_id,
  CAST(target_day AS TIMESTAMP) - INTERVAL 810 MINUTE AS launch_time FROM challenges""")
_SUBS = """SELECT DISTINCT challenge_id || '_' || user_id || '_' || variable AS submission_id, resource_id, challenge_id,
  user_id, variable, CAST(datetime AS DATE) AS target_day, 'normal' AS submission_type FROM {}"""
cte("submissions", "forecasts", _SUBS.format("forecasts"))
cte("submissions_gappy", "forecasts_gappy", _SUBS.format("forecasts_gappy"))
cte("participation", "resources", """SELECT 'f' || lpad(CAST(k AS VARCHAR), 2, '0') AS user_id, resource_id, k = 15 AS is_fixed_payment
  FROM resources CROSS JOIN (SELECT unnest(generate_series(1, 15)) AS k)""")
