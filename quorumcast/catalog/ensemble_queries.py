"""Outliers, ensembles and strategies: registered queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quorumcast.catalog import score_queries
from quorumcast.catalog.ctes import cte, rnd, with_ctes
from quorumcast.catalog.registry import query
from quorumcast.functions.metrics import stable_round
from quorumcast.operators import ensembles as ens
from quorumcast.operators import outliers as out
from quorumcast.operators import scoring, stacking
from quorumcast.operators.profiles import pack
from quorumcast.plans import strategies as st
from quorumcast.sources.event_bridge import SLOT_MINUTES
from quorumcast.staging import stage

ALPHA = 3.0
DAY = 1440

cte("bounds", "forecasts", """SELECT challenge_id, variable, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS n_forecasters
  FROM forecasts GROUP BY 1, 2""")
cte("profile", "forecasts", "SELECT challenge_id, variable, datetime, median(value) AS mid FROM forecasts GROUP BY 1, 2, 3")
cte("sides", "forecasts profile", """SELECT f.challenge_id, f.variable, f.user_id, f.datetime, f.value, p.mid FROM forecasts f
  JOIN profile p ON p.challenge_id = f.challenge_id AND p.variable = f.variable AND p.datetime = f.datetime""")
cte("euclid", "sides bounds", """SELECT s.challenge_id, s.variable, s.user_id, any_value(b.n_forecasters) AS n_forecasters,
  CASE WHEN any_value(b.hi - b.lo) > 0 THEN sqrt(sum((s.value - s.mid) * (s.value - s.mid))) / any_value(b.hi - b.lo) ELSE 0 END AS distance
  FROM sides s JOIN bounds b ON b.challenge_id = s.challenge_id AND b.variable = s.variable GROUP BY 1, 2, 3""")


def _limits(src: str, name: str) -> None:
    cte(f"{name}_mid", src, f"SELECT challenge_id, variable, median(distance) AS median_distance FROM {src} WHERE n_forecasters >= 4 GROUP BY 1, 2")
    cte(f"{name}_limits", f"{src} {name}_mid", f"""SELECT d.challenge_id, d.variable, any_value(m.median_distance) AS median_distance,
      median(abs(d.distance - m.median_distance)) AS mad FROM {src} d
      JOIN {name}_mid m ON m.challenge_id = d.challenge_id AND m.variable = d.variable GROUP BY 1, 2""")
    cte(f"{name}_outliers", f"{src} {name}_limits", f"""SELECT d.challenge_id, d.variable, d.user_id FROM {src} d
      JOIN {name}_limits l ON l.challenge_id = d.challenge_id AND l.variable = d.variable WHERE d.distance > l.median_distance + {ALPHA} * l.mad""")


_limits("euclid", "eu")


@query(with_ctes("bounds", "SELECT * FROM bounds"))
def block_bounds(t):
    return out.block_bounds(t.forecasts())


@query(with_ctes("forecasts bounds", f"""SELECT f.challenge_id, f.variable, f.user_id, f.datetime, {rnd('(f.value - b.lo) / (b.hi - b.lo)', 6)} AS value
  FROM forecasts f JOIN bounds b ON b.challenge_id = f.challenge_id AND b.variable = f.variable WHERE b.hi > b.lo"""))
def minmax_normalise(t):
    n = out.minmax_normalise(t.forecasts())
    return n.select("challenge_id", "variable", "user_id", "datetime", stable_round(F.col("value"), 6).alias("value"))


@query(with_ctes("profile", f"SELECT challenge_id, variable, datetime, {rnd('mid', 6)} AS median FROM profile"))
def median_profile(t):
    return out.median_profile(t.forecasts()).withColumn("median", stable_round(F.col("median"), 6))


@query(with_ctes("euclid", f"SELECT challenge_id, variable, user_id, n_forecasters, {rnd('distance', 6)} AS distance FROM euclid"))
def euclidean_distance(t):
    f = pack(t.forecasts(), SLOT_MINUTES)
    return out.euclidean_distance(f, out.median_profile(f), keep=stage).withColumn("distance", stable_round(F.col("distance"), 6))


@query(with_ctes("eu_limits", f"""SELECT challenge_id, variable, {rnd('median_distance', 6)} AS median_distance, {rnd('mad', 6)} AS mad,
  {rnd(f'median_distance + {ALPHA} * mad', 6)} AS threshold FROM eu_limits""").replace("WHERE n_forecasters >= 4", ""))
def mad_threshold(t):
    limits = out.mad_threshold(out.profile_distances(pack(t.forecasts(), SLOT_MINUTES), 1, "euclidean", keep=stage), ALPHA)
    return limits.select("challenge_id", "variable", *[stable_round(F.col(c), 6).alias(c) for c in ("median_distance", "mad", "threshold")])


@query(with_ctes("eu_outliers", "SELECT * FROM eu_outliers"))
def detect_outliers_euclidean(t):
    return out.detect_outliers(pack(t.forecasts(), SLOT_MINUTES), ALPHA, distance="euclidean", keep=stage)


# Warping distance in SQL: the best path cost of a row of the cost matrix is
# S(j) + min over k <= j of (entry(k) - S(k-1)), S being the running cost of the row
# and entry(k) the cheapest way into cell k from the row above.
_DTW = """numbered AS (SELECT challenge_id, variable, user_id, value, mid,
    row_number() OVER (PARTITION BY challenge_id, variable, user_id ORDER BY datetime) AS i FROM sides),
steps AS (
  SELECT a.challenge_id, a.variable, a.user_id, CAST(1 AS BIGINT) AS i, b.i AS j,
    sum((a.value - b.mid) * (a.value - b.mid)) OVER (PARTITION BY a.challenge_id, a.variable, a.user_id ORDER BY b.i) AS cost
  FROM numbered a JOIN numbered b ON b.challenge_id = a.challenge_id AND b.variable = a.variable AND b.user_id = a.user_id WHERE a.i = 1
  UNION ALL
  SELECT challenge_id, variable, user_id, i, j, run + min(entry - before) OVER (PARTITION BY challenge_id, variable, user_id ORDER BY j)
  FROM (SELECT *, sum(c) OVER (PARTITION BY challenge_id, variable, user_id ORDER BY j) AS run,
      coalesce(sum(c) OVER (PARTITION BY challenge_id, variable, user_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT s.challenge_id, s.variable, s.user_id, s.i + 1 AS i, s.j, (a.value - b.mid) * (a.value - b.mid) AS c,
        least(s.cost, lag(s.cost) OVER (PARTITION BY s.challenge_id, s.variable, s.user_id ORDER BY s.j)) AS entry
      FROM steps s
      JOIN numbered a ON a.challenge_id = s.challenge_id AND a.variable = s.variable AND a.user_id = s.user_id AND a.i = s.i + 1
      JOIN numbered b ON b.challenge_id = s.challenge_id AND b.variable = s.variable AND b.user_id = s.user_id AND b.i = s.j))),
dtw AS (SELECT s.challenge_id, s.variable, s.user_id, b.n_forecasters,
    CASE WHEN b.hi > b.lo THEN sqrt(s.cost) / (b.hi - b.lo) ELSE 0 END AS distance
  FROM (SELECT *, max(i) OVER (PARTITION BY challenge_id, variable, user_id) AS n FROM steps) s
  JOIN bounds b ON b.challenge_id = s.challenge_id AND b.variable = s.variable WHERE s.i = s.n AND s.j = s.n)"""


def _dtw_sql(tail: str, body: str, deps: str = "sides bounds") -> str:
    head = with_ctes(deps, "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return head + ",\n" + _DTW + tail + "\n" + body


@query(_dtw_sql("", f"SELECT challenge_id, variable, user_id, n_forecasters, {rnd('distance', 6)} AS distance FROM dtw"))
def dtw_distance(t):
    f = pack(t.forecasts(), SLOT_MINUTES)
    return out.dtw_distance(f, out.median_profile(f), keep=stage).withColumn("distance", stable_round(F.col("distance"), 6))


_DTW_OUT = f""", dtw_mid AS (SELECT challenge_id, variable, median(distance) AS median_distance FROM dtw WHERE n_forecasters >= 4 GROUP BY 1, 2),
dtw_limits AS (SELECT d.challenge_id, d.variable, any_value(m.median_distance) AS median_distance, median(abs(d.distance - m.median_distance)) AS mad
  FROM dtw d JOIN dtw_mid m ON m.challenge_id = d.challenge_id AND m.variable = d.variable GROUP BY 1, 2),
dtw_outliers AS (SELECT d.challenge_id, d.variable, d.user_id FROM dtw d
  JOIN dtw_limits l ON l.challenge_id = d.challenge_id AND l.variable = d.variable WHERE d.distance > l.median_distance + {ALPHA} * l.mad)"""


@query(_dtw_sql(_DTW_OUT, "SELECT * FROM dtw_outliers"))
def detect_outliers(t):
    return out.detect_outliers(pack(t.forecasts(), SLOT_MINUTES), ALPHA, keep=stage)


def dtw_ctes(prefix: str, block: str, alpha: float = ALPHA) -> None:
    """Outliers by warping distance of another block, and the block without them."""
    b = f"{prefix}_bounds"
    cte(b, block, f"SELECT challenge_id, variable, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS n_forecasters FROM {block} GROUP BY 1, 2")
    cte(f"{prefix}_profile", block, f"SELECT challenge_id, variable, datetime, median(value) AS mid FROM {block} GROUP BY 1, 2, 3")
    cte(f"{prefix}_sides", f"{block} {prefix}_profile", f"""SELECT f.challenge_id, f.variable, f.user_id, f.datetime, f.value, p.mid FROM {block} f
      JOIN {prefix}_profile p ON p.challenge_id = f.challenge_id AND p.variable = f.variable AND p.datetime = f.datetime WHERE f.value IS NOT NULL""")
    names = {n: f"{prefix}_{n}" for n in ("sides", "bounds", "numbered", "steps", "dtw", "dtw_mid", "dtw_limits", "dtw_outliers")}
    text = (_DTW + _DTW_OUT).replace(str(ALPHA), str(alpha))
    text = re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[0]], text)
    before = f"{prefix}_sides {b}"
    for part in re.split(r",\s*(?=\w+ AS \(SELECT|\w+ AS \(\n)", text):
        name, body = part.strip().split(" AS (", 1)
        cte(name, before, body.rsplit(")", 1)[0])
        before = name
    cte(f"{prefix}_kept", f"{block} {prefix}_dtw_outliers", f"""SELECT f.* FROM {block} f WHERE NOT EXISTS (SELECT 1 FROM {prefix}_dtw_outliers o
      WHERE o.challenge_id = f.challenge_id AND o.variable = f.variable AND o.user_id = f.user_id)""")


def rounded(df, digits=6):
    return df.withColumn("value", stable_round(F.col("value"), digits))


SLOTS = "resource_id, challenge_id, variable, datetime"
cte("kept", "forecasts eu_outliers", """SELECT f.* FROM forecasts f WHERE NOT EXISTS (SELECT 1 FROM eu_outliers o
  WHERE o.challenge_id = f.challenge_id AND o.variable = f.variable AND o.user_id = f.user_id)""")


@query(_dtw_sql(_DTW_OUT, f"""SELECT {SLOTS}, {rnd('avg(value)', 6)} AS value FROM forecasts f
  WHERE NOT EXISTS (SELECT 1 FROM dtw_outliers o WHERE o.challenge_id = f.challenge_id AND o.variable = f.variable AND o.user_id = f.user_id)
  GROUP BY ALL""", "sides bounds forecasts"))
def arithmetic_mean(t):
    return rounded(st.ArithmeticMean(outlier_alpha=ALPHA).fit(st.Training(keep=stage)).predict(pack(t.forecasts(), SLOT_MINUTES)))


@query(with_ctes("kept", f"SELECT {SLOTS}, {rnd('avg(value)', 6)} AS value FROM kept GROUP BY ALL"))
def drop_outliers_mean(t):
    f = pack(t.forecasts(), SLOT_MINUTES)
    found = out.detect_outliers(f, ALPHA, distance="euclidean", keep=stage)
    return rounded(ens.mean_ensemble(ens.drop_outliers(f, found)))


@query(with_ctes("forecasts", f"SELECT {SLOTS}, {rnd('median(value)', 6)} AS value FROM forecasts GROUP BY ALL"))
def median_ensemble(t):
    return rounded(ens.median_ensemble(pack(t.forecasts(), SLOT_MINUTES)))


def learned(t):
    f, m, c = pack(t.forecasts(), SLOT_MINUTES), t.measurements(), t.challenges()  # all read its one exchange
    return f, scoring.recent_scores(f, m, c, chunk_minutes=DAY, slot_minutes=SLOT_MINUTES)


MEMBER_KEYS = "m.resource_id, m.challenge_id, m.variable, m.user_id"
cte("members", "forecasts", "SELECT DISTINCT resource_id, challenge_id, variable, user_id FROM forecasts")
cte("member_scores", "members recent", f"""SELECT {MEMBER_KEYS}, r.score FROM members m LEFT JOIN recent r
  ON r.challenge_id = m.challenge_id AND r.variable = m.variable AND r.user_id = m.user_id""")
cte("exp_weights", "member_scores", """SELECT *, e / sum(e) OVER (PARTITION BY challenge_id, variable) AS weight FROM
  (SELECT *, exp(-0.001 * (s - min(s) OVER (PARTITION BY challenge_id, variable))) AS e FROM
    (SELECT *, coalesce(score, 999999) AS s FROM member_scores))""")


def weighted_sql(weights: str) -> str:
    return f"""SELECT f.resource_id, f.challenge_id, f.variable, f.datetime, {rnd('sum(coalesce(f.value * w.weight, 0))', 6)} AS value FROM forecasts f
      LEFT JOIN {weights} w ON w.challenge_id = f.challenge_id AND w.variable = f.variable AND w.user_id = f.user_id GROUP BY 1, 2, 3, 4"""


@query(with_ctes("exp_weights", f"SELECT resource_id, challenge_id, variable, user_id, {rnd('weight', 6)} AS weight FROM exp_weights"))
def exponential_weights(t):
    f, scores = learned(t)
    return ens.exponential_weights(f, scores).withColumn("weight", stable_round(F.col("weight"), 6))


@query(with_ctes("exp_weights forecasts", weighted_sql("exp_weights")))
def weighted_avg_no_outliers(t):
    f, scores = learned(t)
    fitted = st.registry.get("weighted_avg", outlier_detection=False).fit(st.Training(scores=scores))
    return rounded(fitted.predict(f))


_KEPT = f""", dtw_kept AS (SELECT f.* FROM forecasts f WHERE NOT EXISTS (SELECT 1 FROM dtw_outliers o
    WHERE o.challenge_id = f.challenge_id AND o.variable = f.variable AND o.user_id = f.user_id)),
kept_weights AS (SELECT *, e / sum(e) OVER (PARTITION BY challenge_id, variable) AS weight FROM
  (SELECT *, exp(-0.001 * (s - min(s) OVER (PARTITION BY challenge_id, variable))) AS e FROM
    (SELECT {MEMBER_KEYS}, coalesce(r.score, 999999) AS s FROM (SELECT DISTINCT resource_id, challenge_id, variable, user_id FROM dtw_kept) m
     LEFT JOIN recent r ON r.challenge_id = m.challenge_id AND r.variable = m.variable AND r.user_id = m.user_id)))"""


@query(_dtw_sql(_DTW_OUT + _KEPT, weighted_sql("kept_weights").replace("FROM forecasts f", "FROM dtw_kept f"), "sides bounds forecasts recent"))
def weighted_avg(t):
    """The production strategy: outliers by warping distance, exponential weights."""
    f, scores = learned(t)
    fitted = st.registry.get("weighted_avg", outlier_alpha=ALPHA).fit(st.Training(scores=scores, keep=stage))
    return rounded(fitted.predict(f))


cte("best_weights", "members recent", """SELECT resource_id, challenge_id, variable,
  coalesce(max(CASE WHEN user_id = best THEN user_id END), min(user_id)) AS user_id, CAST(1 AS DOUBLE) AS weight FROM
  (SELECT m.*, b.user_id AS best FROM members m LEFT JOIN
    (SELECT challenge_id, variable, user_id FROM (SELECT *, row_number() OVER (PARTITION BY challenge_id, variable ORDER BY score, user_id) AS rn
      FROM recent WHERE score IS NOT NULL) WHERE rn = 1) b ON b.challenge_id = m.challenge_id AND b.variable = m.variable) GROUP BY 1, 2, 3""")


@query(with_ctes("best_weights", "SELECT * FROM best_weights"))
def best_forecaster_weights(t):
    return ens.best_forecaster_weights(*learned(t))


@query(with_ctes("best_weights forecasts", """SELECT f.resource_id, f.challenge_id, f.variable, f.datetime, greatest(f.value, 0) AS value FROM forecasts f
  JOIN best_weights w ON w.challenge_id = f.challenge_id AND w.variable = f.variable AND w.user_id = f.user_id"""))
def best_forecaster(t):
    f, scores = learned(t)
    return st.registry.get("best_forecaster").fit(st.Training(scores=scores, keep=stage)).predict(f)


@query(with_ctes("forecasts", f"""SELECT {SLOTS}, CASE WHEN count(value) >= 3 THEN {rnd('(sum(value) - min(value) - max(value)) / (count(value) - 2)', 6)} END AS value
  FROM forecasts GROUP BY {SLOTS}"""))
def trimmed_mean(t):
    return rounded(ens.trimmed_mean_ensemble(t.forecasts()))


@query(with_ctes("forecasts", f"""SELECT {SLOTS}, {rnd("sum(value * CASE user_id WHEN 'f01' THEN 0.5 WHEN 'f02' THEN 0.3 WHEN 'f03' THEN 0.2 ELSE 0 END)", 6)} AS value
  FROM forecasts GROUP BY {SLOTS}"""))
def fixed_weights(t):
    s = st.registry.get("fixed_weights", weights={"f01": 0.5, "f02": 0.3, "f03": 0.2})
    return rounded(s.fit(st.Training(keep=stage)).predict(t.forecasts()))


cte("normalised_weights", "recent", """SELECT *, e / sum(e) OVER (PARTITION BY challenge_id, variable) AS weight FROM
  (SELECT *, exp(-0.001 * (score - min(score) OVER (PARTITION BY challenge_id, variable))) AS e FROM recent WHERE score IS NOT NULL)""")


@query(with_ctes("normalised_weights forecasts", weighted_sql("normalised_weights")))
def score_weighted(t):
    f, scores = learned(t)
    return rounded(st.registry.get("score_weighted").fit(st.Training(scores=scores)).predict(f))


cte("inverse_weights", "member_scores", """SELECT *, CASE WHEN total IS NULL THEN CAST(1 AS DOUBLE) / n ELSE coalesce(w, 0) / total END AS weight FROM
  (SELECT *, sum(w) OVER (PARTITION BY challenge_id, variable) AS total, count(*) OVER (PARTITION BY challenge_id, variable) AS n FROM
    (SELECT *, CASE WHEN score > 0 THEN 1 / score END AS w FROM member_scores))""")


@query(with_ctes("inverse_weights forecasts", weighted_sql("inverse_weights")))
def inverse_score(t):
    f, scores = learned(t)
    return rounded(st.registry.get("inverse_score").fit(st.Training(scores=scores, keep=stage)).predict(f))


@query(with_ctes("members", f"""SELECT resource_id, challenge_id, variable, user_id,
  {rnd('CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY challenge_id, variable)', 6)} AS weight FROM members"""))
def equal_weights(t):
    return ens.equal_weights(t.forecasts()).withColumn("weight", stable_round(F.col("weight"), 6))


@query(with_ctes("forecasts", f"""SELECT {SLOTS}, greatest({rnd('avg(value) - 60', 6)}, 0) AS value FROM forecasts GROUP BY {SLOTS}"""))
def clip_lower(t):
    shifted = ens.mean_ensemble(t.forecasts()).withColumn("value", stable_round(F.col("value") - 60, 6))
    return ens.clip_lower(shifted, 0.0)


class _Midrange(st.CombineStrategy):
    def combine(self, value):
        return (F.min(value) + F.max(value)) / 2


@query(with_ctes("forecasts", f"SELECT {SLOTS}, {rnd('(min(value) + max(value)) / 2', 6)} AS value FROM forecasts GROUP BY {SLOTS}"))
def custom_combine_strategy(t):
    known = st.Registry()
    known.register("midrange")(_Midrange)
    return rounded(st.run_strategies(t.forecasts(), st.Training(), ["midrange"], strategies=known)).drop("strategy")


class _Unbiased(st.Strategy):
    """Learns every series' mean error and takes it off before averaging."""

    def fit_state(self, training):
        pairs = scoring.align(training.forecasts, training.measurements, "inner")
        return pairs.groupBy("resource_id", "user_id", "variable").agg(F.avg(F.col("observed") - F.col("forecast")).alias("bias"))

    def predict_block(self, block, state):
        rows = block.join(state, ["resource_id", "user_id", "variable"], "left")
        return ens.combine(rows.withColumn("value", F.col("value") + F.coalesce("bias", F.lit(0.0))), F.avg("value"))


@query(with_ctes("forecasts measurements", f"""SELECT f.resource_id, f.challenge_id, f.variable, f.datetime, {rnd('greatest(avg(f.value + b.bias), 0)', 6)} AS value FROM forecasts f
  JOIN (SELECT f.resource_id, f.user_id, f.variable, avg(m.value - f.value) AS bias FROM forecasts f
    JOIN measurements m ON m.resource_id = f.resource_id AND m.datetime = f.datetime GROUP BY 1, 2, 3) b
    ON b.resource_id = f.resource_id AND b.user_id = f.user_id AND b.variable = f.variable GROUP BY 1, 2, 3, 4"""))
def custom_fit_strategy(t):
    """An own strategy with a fitted state, by name from a registry."""
    known = st.Registry()
    known.register("unbiased")(_Unbiased)
    training = st.Training(t.forecasts(), t.measurements(), keep=stage)
    return rounded(st.run_strategies(t.forecasts(), training, known.list_strategies(), strategies=known)).drop("strategy")


_RUN = [("arithmetic_mean", "avg(value)"), ("median", "median(value)"),
        ("trimmed_mean", "CASE WHEN count(value) >= 3 THEN (sum(value) - min(value) - max(value)) / (count(value) - 2) END")]
cte("ran", "forecasts", " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, {SLOTS}, {rnd(x, 6)} AS value FROM forecasts GROUP BY {SLOTS}" for n, x in _RUN))


def ran(t):
    return rounded(st.run_strategies(score_queries.profiles_of(t), st.Training(), [n for n, _ in _RUN],
                                     {"arithmetic_mean": {"outlier_detection": False}}))


@query(with_ctes("ran", "SELECT * FROM ran"))
def run_strategies(t):
    return ran(t)


@query(with_ctes("ran", f"""SELECT {SLOTS}, {', '.join(f"max(CASE WHEN strategy = '{n}' THEN value END) AS {n}" for n, _ in _RUN)} FROM ran GROUP BY {SLOTS}"""))
def compare_strategies(t):
    return ens.compare_strategies(ran(t), [n for n, _ in _RUN])


@query(with_ctes("members best_weights", f"""SELECT 'best_forecaster' AS strategy, resource_id, challenge_id, variable, user_id, weight FROM best_weights
  UNION ALL SELECT 'median', resource_id, challenge_id, variable, user_id, {rnd('CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY challenge_id, variable)', 6)} FROM members"""))
def strategy_weights(t):
    f, scores = learned(t)
    w = st.strategy_weights(f, st.Training(scores=scores, keep=stage), ["best_forecaster", "median"])
    return w.withColumn("weight", stable_round(F.col("weight"), 6))


cte("assigned", "resources", """SELECT resource_id, 'median' AS strategy FROM resources WHERE use_case = 'wind_power'
  UNION ALL SELECT resource_id, 'best_forecaster' FROM resources WHERE use_case <> 'load'""")
cte("resolved", "resources assigned", """SELECT r.resource_id, coalesce(a.strategy, 'weighted_avg') AS strategy FROM resources r
  LEFT JOIN assigned a ON a.resource_id = r.resource_id
  UNION SELECT resource_id, b.s FROM resources CROSS JOIN (SELECT unnest(['arithmetic_mean', 'best_forecaster']) AS s) b""")


def assigned_strategies(t):
    r = t.resources()
    own = r.filter(F.col("use_case") == "wind_power").select("resource_id", F.lit("median").alias("strategy")).unionByName(
        r.filter(F.col("use_case") != "load").select("resource_id", F.lit("best_forecaster").alias("strategy")))
    return ens.resolve_strategies(r, own, "weighted_avg", ("arithmetic_mean", "best_forecaster"))


@query(with_ctes("resolved", "SELECT * FROM resolved"))
def resolve_strategies(t):
    return assigned_strategies(t)


# Normal equations of the centred system, and elimination without pivoting (it is
# positive definite) down to triangular form and back, all models at once.
_RIDGE = """ridge_rows AS (SELECT f.resource_id, f.variable, f.user_id, f.datetime, f.value, m.value AS y FROM forecasts f
  JOIN measurements m ON m.resource_id = f.resource_id AND m.datetime = f.datetime),
ridge_mean AS (SELECT resource_id, variable, user_id, avg(value) AS x_mean FROM ridge_rows GROUP BY 1, 2, 3),
ridge_y AS (SELECT resource_id, variable, avg(y) AS y_mean FROM (SELECT DISTINCT resource_id, variable, datetime, y FROM ridge_rows) GROUP BY 1, 2),
centred AS (SELECT r.resource_id, r.variable, r.datetime, CAST(substr(r.user_id, 2) AS INTEGER) AS k, r.value - n.x_mean AS x, r.y - o.y_mean AS y
  FROM ridge_rows r JOIN ridge_mean n USING (resource_id, variable, user_id) JOIN ridge_y o USING (resource_id, variable)),
cells AS (SELECT a.resource_id, a.variable, a.k AS i, b.k AS j, sum(a.x * b.x) + CASE WHEN a.k = b.k THEN 1 ELSE 0 END AS v
  FROM centred a JOIN centred b USING (resource_id, variable, datetime) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT resource_id, variable, k, 16, sum(x * y) FROM centred GROUP BY 1, 2, 3),
start AS (SELECT resource_id, variable, i, list(coalesce(v, 0) ORDER BY j) AS r FROM (
  SELECT a.resource_id, a.variable, a.i, b.j, c.v FROM (SELECT DISTINCT resource_id, variable, i FROM cells) a
  JOIN (SELECT unnest(generate_series(1, 16)) AS j) b ON true
  LEFT JOIN cells c ON c.resource_id = a.resource_id AND c.variable = a.variable AND c.i = a.i AND c.j = b.j) GROUP BY 1, 2, 3),
solved AS (SELECT 0 AS n, resource_id, variable, i, r FROM start
  UNION ALL SELECT n + 1, s.resource_id, s.variable, s.i,
    CASE WHEN s.i = n + 1 THEN list_transform(s.r, lambda v: v / s.r[n + 1])
    ELSE list_transform(range(1, 17), lambda j: s.r[j] - s.r[n + 1] * p.r[j] / p.r[n + 1]) END
  FROM solved s JOIN solved p USING (n, resource_id, variable) WHERE p.i = n + 1 AND n < 15),
ridge AS (SELECT resource_id, variable, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS user_id, r[16] AS coef FROM solved WHERE n = 15)"""


def _ridge_sql(body: str) -> str:
    return with_ctes("forecasts measurements", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _RIDGE + "\n" + body


def _ridge(t):
    return stacking.ridge_coefficients(pack(t.forecasts(), SLOT_MINUTES), t.measurements())


@query(_ridge_sql(f"""SELECT resource_id, challenge_id, variable, datetime, {rnd('greatest(max(y_mean) + sum(coef * (value - x_mean)), 0)', 4)} AS value
  FROM forecasts JOIN ridge USING (resource_id, variable, user_id) JOIN ridge_mean USING (resource_id, variable, user_id)
  JOIN ridge_y USING (resource_id, variable) GROUP BY 1, 2, 3, 4"""))
def ridge_stacking(t):
    return rounded(stacking.ridge_predict(pack(t.forecasts(), SLOT_MINUTES), _ridge(t)), 4)


@query(_ridge_sql(f"""SELECT resource_id, variable, user_id, {rnd('CASE WHEN total > 0 THEN w / total ELSE w END', 6)} AS weight FROM
  (SELECT *, sum(w) OVER (PARTITION BY resource_id, variable) AS total FROM (SELECT *, greatest(coef, 0) AS w FROM ridge))"""))
def ridge_weights(t):
    return stacking.ridge_weights(_ridge(t)).withColumn("weight", stable_round(F.col("weight"), 6))
