"""Scores: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumcast.catalog import gate_queries  # noqa: F401  (defines shared SQL tables)
from quorumcast.catalog.ctes import cte, rnd, with_ctes
from quorumcast.catalog.registry import query
from quorumcast.functions import metrics as M
from quorumcast.operators import scoring
from quorumcast.operators.profiles import pack
from quorumcast.sources.event_bridge import SLOT_MINUTES
from quorumcast.staging import stage

cte("aligned", "forecasts measurements", """SELECT f.*, m.value AS observed FROM forecasts f
  LEFT JOIN measurements m ON m.resource_id = f.resource_id AND m.datetime = f.datetime""")
PIN = ("CASE WHEN observed > {f} THEN {q} * (observed - {f}) ELSE ({q} - 1) * (observed - {f}) END")
QLEVEL = "(CAST(substr(variable, 2) AS DOUBLE) / 100)"
WINK = ("(q90 - q10) + CASE WHEN observed < q10 THEN 10 * (q10 - observed) ELSE 0 END"
        " + CASE WHEN observed > q90 THEN 10 * (observed - q90) ELSE 0 END")
cte("single_scores", "aligned", f"""SELECT resource_id, challenge_id, user_id, variable,
  {rnd('avg(' + PIN.format(f='value', q=QLEVEL) + ')')} AS pinball,
  {rnd('sqrt(avg((observed - value) * (observed - value)))')} AS rmse,
  {rnd('avg(abs(observed - value))')} AS mae FROM aligned GROUP BY 1, 2, 3, 4""")
cte("intervals", "aligned", """SELECT resource_id, challenge_id, user_id, datetime, max(observed) AS observed,
  max(CASE WHEN variable = 'q10' THEN value END) AS q10, max(CASE WHEN variable = 'q90' THEN value END) AS q90
  FROM aligned GROUP BY 1, 2, 3, 4""")
cte("winkler_scores", "intervals", f"""SELECT resource_id, challenge_id, user_id, {rnd(f'avg({WINK})')} AS winkler
  FROM intervals GROUP BY 1, 2, 3""")
cte("skill", "single_scores winkler_scores", """SELECT resource_id, challenge_id, user_id, variable, 'pinball' AS metric, pinball AS value FROM single_scores
  UNION ALL SELECT resource_id, challenge_id, user_id, variable, 'rmse', rmse FROM single_scores WHERE variable = 'q50'
  UNION ALL SELECT resource_id, challenge_id, user_id, variable, 'mae', mae FROM single_scores WHERE variable = 'q50'
  UNION ALL SELECT resource_id, challenge_id, user_id, v.variable, 'winkler', winkler FROM winkler_scores
    CROSS JOIN (SELECT unnest(['q10', 'q90']) AS variable) v""")


@query(with_ctes("skill", "SELECT * FROM skill"))
def skill_scores(t):
    return scoring.skill_scores(t.forecasts(), t.measurements())


@query("""SELECT variable, CAST(substr(variable, 2) AS DOUBLE) / 100 AS level, n FROM (""" + with_ctes(
    "forecasts", "SELECT variable, count(*) AS n FROM forecasts GROUP BY 1") + ")")
def quantile_level(t):
    return t.forecasts().groupBy("variable").agg(F.count(F.lit(1)).alias("n")).withColumn("level", M.quantile_level(F.col("variable")))


@query(with_ctes("aligned", f"""SELECT resource_id, user_id, variable, {rnd('sum(' + PIN.format(f='value', q=QLEVEL) + ')', 6)} AS pinball_sum,
  {rnd('sum((observed - value) * (observed - value))', 4)} AS squared_sum, {rnd('sum(abs(observed - value))', 6)} AS absolute_sum
  FROM aligned GROUP BY 1, 2, 3"""))
def observation_losses(t):
    rows = scoring.align(t.forecasts(), t.measurements())
    o, f = F.col("observed"), F.col("forecast")
    return rows.groupBy("resource_id", "user_id", "variable").agg(
        M.stable_round(F.sum(M.pinball_obs(o, f, M.quantile_level(F.col("variable")))), 6).alias("pinball_sum"),
        M.stable_round(F.sum(M.squared_error_obs(o, f)), 4).alias("squared_sum"),
        M.stable_round(F.sum(M.absolute_error_obs(o, f)), 6).alias("absolute_sum"),
    )


@query(with_ctes("intervals", f"SELECT resource_id, challenge_id, user_id, datetime, {rnd(WINK, 6)} AS winkler FROM intervals"))
def winkler_obs(t):
    wide = scoring.quantiles_wide(scoring.align(t.forecasts(), t.measurements()), ["resource_id", "challenge_id", "user_id"], ("q10", "q90"))
    w = M.winkler_obs(F.col("q10"), F.col("q90"), F.col("observed"))
    return wide.select("resource_id", "challenge_id", "user_id", "datetime", M.stable_round(w, 6).alias("winkler"))


@query(with_ctes("winkler_scores", "SELECT * FROM winkler_scores"))
def winkler(t):
    wide = scoring.quantiles_wide(scoring.align(t.forecasts(), t.measurements()), ["resource_id", "challenge_id", "user_id"], ("q10", "q90"))
    return wide.groupBy("resource_id", "challenge_id", "user_id").agg(M.winkler(F.col("q10"), F.col("q90"), F.col("observed")).alias("winkler"))


@query(with_ctes("aligned", f"""SELECT resource_id, user_id, variable, {rnd('avg(' + PIN.format(f='value', q=QLEVEL) + ')')} AS pinball,
  {rnd('sqrt(avg((observed - value) * (observed - value)))')} AS rmse, {rnd('avg(abs(observed - value))')} AS mae,
  {rnd('avg((observed - value) * (observed - value))')} AS mse FROM aligned GROUP BY 1, 2, 3"""))
def series_metrics(t):
    rows = scoring.align(t.forecasts(), t.measurements())
    o, f = F.col("observed"), F.col("forecast")
    return rows.groupBy("resource_id", "user_id", "variable").agg(
        M.pinball(o, f, M.quantile_level(F.col("variable"))).alias("pinball"), M.rmse(o, f).alias("rmse"),
        M.mae(o, f).alias("mae"), M.mse(o, f).alias("mse"),
    )


_BOX = """{lo} AS min, {q1} AS q1, {md} AS median, {q3} AS q3, {hi} AS max"""


def box_sql(x: str) -> str:
    return _BOX.format(lo=rnd(f"min({x})"), q1=rnd(f"quantile_cont({x}, 0.25)"), md=rnd(f"quantile_cont({x}, 0.5)"),
                       q3=rnd(f"quantile_cont({x}, 0.75)"), hi=rnd(f"max({x})"))


@query(with_ctes("aligned", f"""SELECT resource_id, challenge_id, user_id, {box_sql('(observed - value) * (observed - value)')},
  count(*) AS n_samples FROM aligned WHERE variable = 'q50' GROUP BY 1, 2, 3"""))
def mse_boxplot(t):
    return scoring.mse_boxplot(t.forecasts(), t.measurements())


cte("winkler_rows", "intervals", f"SELECT resource_id, challenge_id, user_id, {WINK} AS w FROM intervals")
cte("winkler_box", "winkler_rows", f"""SELECT resource_id, challenge_id, user_id, {box_sql('w')}, quantile_cont(w, 0.25) AS a, quantile_cont(w, 0.75) AS b
  FROM winkler_rows GROUP BY 1, 2, 3""")


@query(with_ctes("winkler_box winkler_rows", f"""SELECT x.resource_id, x.challenge_id, x.user_id, x.min, x.q1, x.median, x.q3, x.max,
  count(r.w) AS n_outliers, {rnd('coalesce(sum(r.w), 0)', 6)} AS outlier_sum FROM winkler_box x
  LEFT JOIN winkler_rows r ON r.challenge_id = x.challenge_id AND r.user_id = x.user_id
    AND (r.w < a - 1.5 * (b - a) OR r.w > b + 1.5 * (b - a)) GROUP BY ALL"""))
def winkler_boxplot(t):
    box = scoring.winkler_boxplot(t.forecasts(), t.measurements())
    total = F.aggregate("outliers", F.lit(0.0), lambda acc, x: acc + x)
    return box.withColumn("n_outliers", F.size("outliers").cast("bigint")).withColumn("outlier_sum", M.stable_round(total, 6)).drop("outliers")


LOSS = "CASE WHEN variable = 'q50' THEN (observed - value) * (observed - value) ELSE " + PIN.format(f="value", q=QLEVEL) + " END"
cte("recent", "aligned challenges", f"""SELECT c.resource_id, c.challenge_id, a.user_id, a.variable,
  CASE WHEN a.variable = 'q50' THEN {rnd('sqrt(avg(loss))')} ELSE {rnd('avg(loss)')} END AS score, count(*) AS n_samples
  FROM challenges c JOIN (SELECT *, {LOSS} AS loss FROM aligned) a ON a.resource_id = c.resource_id
    AND a.datetime >= c.start_datetime - INTERVAL 6 DAY AND a.datetime < c.start_datetime
  GROUP BY c.resource_id, c.challenge_id, a.user_id, a.variable""")


@query(with_ctes("recent", "SELECT * FROM recent"))
def recent_scores(t):
    return scoring.recent_scores(t.forecasts(), t.measurements(), t.challenges(), chunk_minutes=1440)


@query(with_ctes("aligned", f"""SELECT resource_id, user_id, variable,
  CAST(datetime + CASE WHEN resource_id LIKE 'click%' OR resource_id LIKE 'view%' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS DATE) AS local_day,
  {rnd(f'avg({LOSS})', 6)} AS score FROM aligned GROUP BY 1, 2, 3, 4"""))
def daily_scores(t):
    from quorumcast.catalog.grid_queries import zoned_resources

    return scoring.daily_scores(t.forecasts(), t.measurements(), zoned_resources(t))


_ZL = ("CASE WHEN variable = 'q50' THEN (m.value - coalesce(f.value, 0)) * (m.value - coalesce(f.value, 0)) ELSE "
       + PIN.format(f="coalesce(f.value, 0)", q="(CAST(substr(k.variable, 2) AS DOUBLE) / 100)").replace("observed", "m.value") + " END")
_ZL = _ZL.replace("WHEN variable", "WHEN k.variable")


def _scored(part: str) -> str:
    return f"""CASE WHEN variable = 'q50' THEN {rnd(f'sqrt(sum(CASE WHEN {part} THEN loss END) / count(CASE WHEN {part} THEN 1 END))')}
    ELSE {rnd(f'sum(CASE WHEN {part} THEN loss END) / count(CASE WHEN {part} THEN 1 END)')} END"""


cte("imputed", "complete_users challenges measurements forecasts", f"""SELECT c.resource_id, c.challenge_id, k.user_id, k.variable, m.datetime,
  c.start_datetime, {_ZL} AS loss
  FROM (SELECT u.*, v.variable FROM complete_users u CROSS JOIN (SELECT unnest(['q10', 'q50', 'q90']) AS variable) v) k
  JOIN challenges c ON c.challenge_id = k.challenge_id
  JOIN measurements m ON m.resource_id = c.resource_id AND m.datetime < c.start_datetime + INTERVAL 2 DAY
  LEFT JOIN forecasts f ON f.resource_id = m.resource_id AND f.datetime = m.datetime AND f.user_id = k.user_id AND f.variable = k.variable""")
_REC, _PAST = "datetime >= start_datetime - INTERVAL 6 DAY", "datetime < start_datetime - INTERVAL 6 DAY"


@query(with_ctes("imputed", f"""SELECT resource_id, challenge_id, user_id, variable, {_scored(_REC)} AS recent_score, {_scored(_PAST)} AS past_score,
  count(CASE WHEN {_REC} THEN 1 END) AS n_recent_samples, count(CASE WHEN {_PAST} THEN 1 END) AS n_past_samples
  FROM imputed GROUP BY 1, 2, 3, 4"""))
def assessment_report(t):
    from quorumcast.operators.gates import complete_quantile_forecasters

    valid = complete_quantile_forecasters(t.forecasts_gappy(), t.challenges(), slot_minutes=60)
    return scoring.assessment_report(t.forecasts(), t.measurements(), t.challenges(), valid)


@query(with_ctes("forecasts", "SELECT * FROM forecasts WHERE variable = 'q90'"))
def quantile_slice(t):
    return scoring.quantile_slice(t.forecasts(), "q90")


@query(with_ctes("aligned", f"""SELECT resource_id, user_id, variable, 'rmse' AS metric, {rnd('sqrt(avg((observed - value) * (observed - value)))')} AS value
  FROM aligned WHERE variable = 'q50' GROUP BY 1, 2, 3
  UNION ALL SELECT resource_id, user_id, variable, 'pinball', {rnd('avg(' + PIN.format(f='value', q=QLEVEL) + ')')} FROM aligned GROUP BY 1, 2, 3"""))
def simple_skill_scores(t):
    return scoring.skill_scores(t.forecasts(), t.measurements(), ("resource_id", "user_id"), metrics=("rmse", "pinball"), how="inner")


cte("ensemble_two", "forecasts", """SELECT 'arithmetic_mean' AS strategy, resource_id, challenge_id, variable, datetime, avg(value) AS value
  FROM forecasts GROUP BY ALL
  UNION ALL SELECT 'median', resource_id, challenge_id, variable, datetime, median(value) FROM forecasts GROUP BY ALL""")
cte("ensemble_obs", "ensemble_two measurements", """SELECT e.*, m.value AS observed FROM ensemble_two e
  JOIN measurements m ON m.resource_id = e.resource_id AND m.datetime = e.datetime""")
cte("ensemble_wide", "ensemble_obs", """SELECT strategy, resource_id, challenge_id, datetime, max(observed) AS observed,
  max(CASE WHEN variable = 'q10' THEN value END) AS q10, max(CASE WHEN variable = 'q50' THEN value END) AS q50,
  max(CASE WHEN variable = 'q90' THEN value END) AS q90 FROM ensemble_obs GROUP BY 1, 2, 3, 4""")
_EVAL = f"""SELECT {{k}}, variable, count(*) AS n_observations,
  CASE WHEN variable = 'q50' THEN {rnd('sqrt(avg((observed - value) * (observed - value)))')} END AS rmse,
  CASE WHEN variable = 'q50' THEN {rnd('avg(abs(observed - value))')} END AS mae,
  {rnd('avg(' + PIN.format(f='value', q=QLEVEL) + ')')} AS pinball, CAST(NULL AS DOUBLE) AS winkler FROM ensemble_obs GROUP BY {{k}}, variable
  UNION ALL SELECT {{k}}, 'interval', count(*), NULL, NULL, NULL, {rnd(f'avg({WINK})')} FROM ensemble_wide GROUP BY {{k}}"""
cte("evaluated", "ensemble_obs ensemble_wide", _EVAL.format(k="strategy, resource_id"))


def profiles_of(t):
    """The forecasts packed and written once, for queries that read them several times."""
    return stage(pack(t.forecasts(), SLOT_MINUTES), "profiles")


def two_ensembles(t):
    from quorumcast.operators import ensembles as ens

    f = pack(t.forecasts(), SLOT_MINUTES)  # both read its one exchange
    return ens.mean_ensemble(f).withColumn("strategy", F.lit("arithmetic_mean")).unionByName(
        ens.median_ensemble(f).withColumn("strategy", F.lit("median"))
    )


@query(with_ctes("evaluated", "SELECT * FROM evaluated"))
def evaluate_strategies(t):
    made = stage(two_ensembles(t), "ensembles")  # read for the quantiles and for the interval
    return scoring.evaluate_strategies(made, t.measurements(), ("strategy", "resource_id"))


@query(with_ctes("evaluated", f"""SELECT strategy, variable, {rnd('avg(rmse)')} AS rmse, {rnd('avg(mae)')} AS mae, {rnd('avg(pinball)')} AS pinball,
  {rnd('avg(winkler)')} AS winkler FROM evaluated GROUP BY 1, 2"""))
def evaluation_summary(t):
    return scoring.evaluation_summary(evaluate_strategies(t))


@query(with_ctes("ensemble_wide", f"""SELECT strategy, {rnd('sqrt(avg((observed - q50) * (observed - q50)))')} AS rmse, {rnd('avg(abs(observed - q50))')} AS mae,
  {', '.join(rnd('avg(' + PIN.format(f=q, q=str(int(q[1:]) / 100)) + ')') + f' AS pinball_{q}' for q in ('q10', 'q50', 'q90'))},
  {rnd(f'avg({WINK})')} AS winkler FROM ensemble_wide GROUP BY 1"""))
def strategy_metrics_wide(t):
    return scoring.strategy_metrics_wide(two_ensembles(t), t.measurements())


cte("card_rows", "aligned ensemble_two", """SELECT a.*, CASE WHEN a.variable = 'q50' THEN e.value END AS ensemble FROM aligned a
  LEFT JOIN ensemble_two e ON e.strategy = 'arithmetic_mean' AND e.resource_id = a.resource_id AND e.datetime = a.datetime AND e.variable = a.variable""")


@query(with_ctes("card_rows intervals", f"""SELECT *, round(CAST(n_samples AS DOUBLE) / 720 * 100, 1) AS coverage_pct FROM (
  SELECT resource_id, user_id, variable, count(*) AS n_samples,
  CASE WHEN variable = 'q50' THEN {rnd('sqrt(avg((observed - value) * (observed - value)))')} END AS rmse,
  CASE WHEN variable = 'q50' THEN {rnd('avg(abs(observed - value))')} END AS mae,
  {rnd('avg(' + PIN.format(f='value', q=QLEVEL) + ')')} AS pinball, CAST(NULL AS DOUBLE) AS winkler,
  {rnd('sqrt(avg((observed - ensemble) * (observed - ensemble)))')} AS ensemble_rmse, {rnd('avg(abs(observed - ensemble))')} AS ensemble_mae
  FROM card_rows GROUP BY 1, 2, 3
  UNION ALL SELECT resource_id, user_id, 'winkler', count(*), NULL, NULL, NULL, {rnd(f'avg({WINK})')}, NULL, NULL FROM intervals GROUP BY 1, 2)"""))
def forecaster_scorecard(t):
    from quorumcast.operators.ensembles import mean_ensemble

    return scoring.forecaster_scorecard(t.forecasts(), t.measurements(), mean_ensemble(pack(t.forecasts(), SLOT_MINUTES)), max_samples=720)
