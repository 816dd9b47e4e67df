"""Time-series features: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumcast.catalog.ctes import rnd, with_ctes
from quorumcast.catalog.registry import query
from quorumcast.functions.metrics import stable_round
from quorumcast.operators import features, scoring

_W = "WINDOW w AS (PARTITION BY resource_id ORDER BY datetime)"


def _rounded(df, digits=6):
    names = [c for c in df.columns if c not in ("resource_id", "datetime", "variable")]
    return df.select(*[stable_round(F.col(c), digits).alias(c) if c in names else c for c in df.columns])


@query(with_ctes("measurements", f"""SELECT resource_id, datetime, lag(value, 1) OVER w AS "value_t-1", lag(value, 2) OVER w AS "value_t-2",
  lag(value, 3) OVER w AS "value_t-3" FROM measurements {_W}"""))
def lag_features(t):
    return features.lag_features(t.measurements(), max_lags=3, columns=["value", "not_there"])


@query(with_ctes("measurements", f"""SELECT resource_id, datetime, {rnd('value - lag(value, 1) OVER w', 6)} AS value_diff,
  {rnd('value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w', 6)} AS value_diff2,
  {rnd('value - 3 * lag(value, 1) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w', 6)} AS value_diff3 FROM measurements {_W}"""))
def difference_features(t):
    return _rounded(features.difference_features(t.measurements(), order_n=3))


@query(with_ctes("measurements", f"""SELECT resource_id, datetime, {rnd('avg(value) OVER r', 6)} AS value_avg, {rnd('stddev_samp(value) OVER r', 6)} AS value_std,
  {rnd('var_samp(value) OVER r', 6)} AS value_var, min(value) OVER r AS value_min, max(value) OVER r AS value_max FROM measurements
  WINDOW r AS (PARTITION BY resource_id ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def rolling_features(t):
    out = features.rolling_features(t.measurements(), window=4, stats=("mean", "std", "var", "min", "max", "mode"))
    return out.select("resource_id", "datetime", "value_min", "value_max",
                      *[stable_round(F.col(c), 6).alias(c) for c in ("value_avg", "value_std", "value_var")])


@query(with_ctes("measurements", f"""SELECT resource_id, datetime, {rnd('value * value', 4)} AS value_sqr, {rnd('value * value * value', 2)} AS value_cub
  FROM measurements"""))
def polynomial_features(t):
    out = features.polynomial_features(t.measurements(), degree=3)
    return out.select("resource_id", "datetime", stable_round(F.col("value_sqr"), 4).alias("value_sqr"), stable_round(F.col("value_cub"), 2).alias("value_cub"))


@query(with_ctes("forecasts", f"""SELECT resource_id, variable, datetime, {rnd('stddev_samp(value)', 6)} AS forecasters_std,
  {rnd('var_samp(value)', 6)} AS forecasters_var, {rnd('avg(value)', 6)} AS forecasters_mean FROM forecasts GROUP BY 1, 2, 3"""))
def diversity_features(t):
    return _rounded(features.diversity_features(t.forecasts()))


@query(with_ctes("forecasts", f"""SELECT resource_id, variable, datetime, {rnd('stddev_samp(value)', 6)} AS forecasters_std,
  {rnd('var_samp(value)', 6)} AS forecasters_var, {rnd('avg(value)', 6)} AS forecasters_mean FROM forecasts WHERE variable = 'q50' GROUP BY 1, 2, 3"""))
def diversity_features_q50(t):
    return _rounded(features.diversity_features(t.forecasts(), quantile="q50"))


class _Standardise(features.FeatureTransformer):
    """Value less its resource's mean."""

    def learn(self, df):
        return df.groupBy("resource_id").agg(F.avg("value").alias("_mean"))

    def apply(self, df, learnt):
        return df.join(learnt, "resource_id").select("resource_id", "datetime", (F.col("value") - F.col("_mean")).alias("value"))


@query(with_ctes("measurements", f"""SELECT resource_id, datetime, {rnd('value - avg(value) OVER (PARTITION BY resource_id)', 6)} AS value FROM measurements"""))
def custom_feature_transformer(t):
    out = features.run_steps(t.measurements(), [_Standardise()])
    return out.withColumn("value", stable_round(F.col("value"), 6))


@query(with_ctes("measurements forecasts", f"""SELECT f.resource_id, f.user_id, f.variable, 'max_error' AS metric, {rnd('max(abs(m.value - f.value))', 6)} AS value
  FROM forecasts f JOIN measurements m ON m.resource_id = f.resource_id AND m.datetime = f.datetime GROUP BY 1, 2, 3"""))
def custom_scorer(t):
    worst = lambda observed, forecast, level: F.max(F.abs(observed - forecast))
    out = scoring.skill_scores(t.forecasts(), t.measurements(), ("resource_id", "user_id"), metrics=(), how="inner", scorers={"max_error": worst})
    return out.withColumn("value", stable_round(F.col("value"), 6))
