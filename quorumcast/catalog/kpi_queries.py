"""Monthly KPIs and report: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumcast.catalog.ctes import cte, rnd, with_ctes
from quorumcast.catalog.registry import query
from quorumcast.catalog.score_queries import box_sql
from quorumcast.functions.metrics import stable_round
from quorumcast.operators import gates, kpi, report, scoring
from quorumcast.staging import stage

BOARD = "resource_id, track, month"
PLAYER = f"{BOARD}, user_id"

cte("scores", "skill challenges", """SELECT s.*, c.target_day FROM skill s JOIN challenges c ON c.challenge_id = s.challenge_id""")
cte("tracked_all", "scores", """SELECT resource_id, CASE WHEN metric = 'rmse' THEN 'deterministic' ELSE 'probabilistic' END AS track,
  CAST(date_trunc('month', target_day) AS DATE) AS month, challenge_id, target_day, user_id, value FROM scores
  WHERE (metric = 'rmse' AND variable = 'q50') OR (metric = 'winkler' AND variable = 'q90')""")
cte("tracked", "tracked_all participation", """SELECT s.* FROM tracked_all s WHERE NOT EXISTS (SELECT 1 FROM participation p
  WHERE p.is_fixed_payment AND p.resource_id = s.resource_id AND p.user_id = s.user_id)""")
cte("ranks", "tracked", f"""SELECT *, dense_rank() OVER (PARTITION BY {BOARD}, challenge_id, target_day ORDER BY value) AS rank FROM tracked""")
cte("daily", "tracked", f"SELECT {PLAYER}, target_day, avg(value) AS score FROM tracked GROUP BY {PLAYER}, target_day")
cte("penalties", "daily", f"SELECT {BOARD}, target_day, quantile_cont(score, 0.75) AS penalty FROM daily GROUP BY {BOARD}, target_day")
cte("filled", "daily penalties", """SELECT p.resource_id, p.track, p.month, u.user_id, p.target_day, coalesce(d.score, p.penalty) AS score,
  d.score IS NULL AS is_penalty FROM penalties p
  JOIN (SELECT DISTINCT resource_id, track, month, user_id FROM daily) u ON u.resource_id = p.resource_id AND u.track = p.track AND u.month = p.month
  LEFT JOIN daily d ON d.resource_id = p.resource_id AND d.track = p.track AND d.month = p.month AND d.user_id = u.user_id AND d.target_day = p.target_day""")


def spread_sql(x: str, prefix: str, suffix: str = "", whole: bool = False) -> str:
    r = (lambda e: e) if whole else (lambda e: rnd(e, 6))
    return f"""{rnd(f'avg({x})', 6)} AS avg_{prefix}{suffix}, {r(f'min({x})')} AS best_{prefix}{suffix}, {r(f'max({x})')} AS worst_{prefix}{suffix},
      {rnd(f'median({x})', 6)} AS median_{prefix}{suffix}, {rnd(f'coalesce(stddev_samp({x}), 0)', 6)} AS std_{prefix}{suffix}"""


cte("penalised", "filled", f"""SELECT {PLAYER}, avg(score) AS a, count(CASE WHEN is_penalty THEN 1 END) AS n_days_w_penalties FROM filled GROUP BY {PLAYER}""")
cte("positions", "penalised", f"""SELECT {PLAYER}, row_number() OVER (PARTITION BY {BOARD} ORDER BY {rnd('a', 9)}, user_id) AS position FROM penalised WHERE n_days_w_penalties <= 5""")
cte("leagues", "penalised positions", """SELECT p.resource_id, p.track, p.month, p.user_id, CASE WHEN n_days_w_penalties > 5 THEN 'unqualified' WHEN position <= 5 THEN 'elite'
  WHEN position <= 10 THEN 'challenger' WHEN position = 11 THEN 'runner_up' ELSE 'unassigned' END AS league_id, CASE WHEN position <= 11 THEN position END AS position
  FROM penalised p LEFT JOIN positions q ON q.resource_id = p.resource_id AND q.track = p.track AND q.month = p.month AND q.user_id = p.user_id""")


def scores(t):
    s = scoring.skill_scores(t.forecasts(), t.measurements(), metrics=("rmse", "winkler"))
    return s.join(t.challenges().select("challenge_id", "target_day"), "challenge_id")


def tracked(t):
    """Scores are a stored table that many steps read, so they are written first."""
    return stage(kpi.track_scores(gates.drop_fixed_payment(scores(t), t.participation())), "track-scores")


def rnd_cols(df, digits=6, skip=()):
    return df.select(*[stable_round(F.col(c), digits).alias(c) if d == "double" and c not in skip else F.col(c) for c, d in df.dtypes])


@query(with_ctes("tracked_all", "SELECT * FROM tracked_all"))
def track_scores(t):
    return kpi.track_scores(scores(t))


@query(with_ctes("tracked_all", f"SELECT month, track, count(*) AS n, {rnd('sum(value)', 3)} AS total FROM tracked_all GROUP BY 1, 2"))
def month_key(t):
    return kpi.track_scores(scores(t)).groupBy("month", "track").agg(F.count(F.lit(1)).alias("n"), stable_round(F.sum("value"), 3).alias("total"))


@query(with_ctes("tracked", "SELECT * FROM tracked"))
def drop_fixed_payment(t):
    return tracked(t)


@query(with_ctes("scores", "SELECT challenge_id, user_id, variable, metric, value FROM scores WHERE metric IN ('rmse', 'winkler') AND target_day NOT IN (DATE '2024-01-10', DATE '2024-01-11')"))
def drop_dates(t):
    return gates.drop_dates(scores(t), ["2024-01-10", "2024-01-11"]).select("challenge_id", "user_id", "variable", "metric", "value")


@query(with_ctes("scores submissions_gappy", """SELECT s.challenge_id, s.user_id, s.variable, s.metric, s.value FROM scores s WHERE metric IN ('rmse', 'winkler') AND NOT EXISTS
  (SELECT 1 FROM (SELECT challenge_id, user_id FROM submissions_gappy GROUP BY 1, 2 HAVING count(*) <> 3) p WHERE p.challenge_id = s.challenge_id AND p.user_id = s.user_id)"""))
def drop_partial_submissions(t):
    kept = gates.drop_partial_submissions(scores(t), t.submissions(t.forecasts_gappy()))
    return kept.select("challenge_id", "user_id", "variable", "metric", "value")


@query(with_ctes("ranks", "SELECT * FROM ranks"))
def daily_ranking(t):
    return kpi.daily_ranking(tracked(t))


_PODIUM = "count(CASE WHEN rank <= 3 THEN 1 END)"


@query(with_ctes("ranks", f"""SELECT {PLAYER}, {spread_sql('rank', 'rank', whole=True)}, count(*) AS days_with_submissions,
  CAST(floor(avg(rank)) AS BIGINT) AS avg_rank_int, {_PODIUM} AS podium_count, {rnd(f'{_PODIUM} / CAST(count(*) AS DOUBLE) * 100', 6)} AS podium_pct,
  count(CASE WHEN rank <= 5 THEN 1 END) AS rank_1_5, count(CASE WHEN rank BETWEEN 6 AND 10 THEN 1 END) AS rank_6_10,
  count(CASE WHEN rank > 10 THEN 1 END) AS rank_11_plus FROM ranks GROUP BY {PLAYER}"""))
def month_rank_stats(t):
    """Also podium and rank distribution."""
    return rnd_cols(kpi.month_rank_stats(kpi.daily_ranking(tracked(t))))


@query(with_ctes("ranks", f"SELECT {BOARD}, count(DISTINCT user_id) AS nr_participants FROM ranks GROUP BY {BOARD}"))
def participant_count(t):
    return kpi.participant_count(kpi.daily_ranking(tracked(t)))


@query(with_ctes("ranks", f"""SELECT *, max(days_with_submissions) OVER (PARTITION BY {BOARD}) AS days_in_period, count(*) OVER (PARTITION BY {BOARD}) AS nr_participants,
  {rnd(f'CAST(days_with_submissions AS DOUBLE) / max(days_with_submissions) OVER (PARTITION BY {BOARD}) * 100', 6)} AS participation_rate
  FROM (SELECT {PLAYER}, count(*) AS days_with_submissions FROM ranks GROUP BY {PLAYER})"""))
def participation_stats(t):
    return rnd_cols(kpi.participation_stats(kpi.month_rank_stats(kpi.daily_ranking(tracked(t)))))


@query(with_ctes("daily", f"SELECT {PLAYER}, target_day, {rnd('score', 6)} AS score FROM daily"))
def daily_score_matrix(t):
    return rnd_cols(kpi.daily_score_matrix(tracked(t)))


@query(with_ctes("daily", f"SELECT {PLAYER}, {spread_sql('score', 'score')} FROM daily GROUP BY {PLAYER}"))
def month_score_stats(t):
    return rnd_cols(kpi.month_score_stats(kpi.daily_score_matrix(tracked(t))))


def filled(t):
    return kpi.penalty_fill(kpi.daily_score_matrix(tracked(t)))


@query(with_ctes("filled", f"SELECT {PLAYER}, target_day, {rnd('score', 6)} AS score, is_penalty FROM filled"))
def penalty_fill(t):
    return rnd_cols(filled(t))


@query(with_ctes("filled", f"SELECT {PLAYER}, count(CASE WHEN is_penalty THEN 1 END) AS n_days_w_penalties FROM filled GROUP BY {PLAYER}"))
def missing_days(t):
    return kpi.missing_days(filled(t))


@query(with_ctes("filled", f"""SELECT {PLAYER}, {spread_sql('score', 'score', '_w_pen')}, count(CASE WHEN is_penalty THEN 1 END) AS n_days_w_penalties
  FROM filled GROUP BY {PLAYER}"""))
def month_score_stats_w_penalty(t):
    return rnd_cols(kpi.month_score_stats_w_penalty(filled(t)))


def penalised(t):
    return kpi.month_score_stats_w_penalty(filled(t))


@query(with_ctes("penalised", f"SELECT {PLAYER}, dense_rank() OVER (PARTITION BY {BOARD} ORDER BY {rnd('a', 9)}) AS avg_score_w_pen_rank FROM penalised"))
def month_rank_w_penalty(t):
    return kpi.month_rank_w_penalty(penalised(t))


@query(with_ctes("leagues", "SELECT * FROM leagues"))
def league_assignment(t):
    return kpi.league_assignment(penalised(t))


@query(with_ctes("filled", f"""SELECT {BOARD}, target_day, {', '.join(rnd(f'max(CASE WHEN rn = {k} THEN cum END)', 6) + f' AS {n}' for k, n in ((5, 'elite'), (10, 'challenger'), (11, 'runner_up')))}
  FROM (SELECT *, row_number() OVER (PARTITION BY {BOARD}, target_day ORDER BY cum) AS rn FROM
    (SELECT *, avg(score) OVER (PARTITION BY {PLAYER} ORDER BY target_day) AS cum FROM filled)) GROUP BY {BOARD}, target_day"""))
def league_thresholds(t):
    return rnd_cols(kpi.league_thresholds(filled(t)))


@query(with_ctes("penalised", f"""SELECT p.resource_id, p.track, p.month, p.user_id, {rnd('m.podium', 6)} AS avg_score_w_pen_podium,
  CASE WHEN m.podium > 0 THEN {rnd('p.a - m.podium', 6)} END AS diff_podium_score_w_pen FROM penalised p JOIN (SELECT {BOARD}, avg(a) AS podium FROM
    (SELECT *, row_number() OVER (PARTITION BY {BOARD} ORDER BY a) AS rn FROM penalised) WHERE rn <= 3 GROUP BY {BOARD}) m
  ON m.resource_id = p.resource_id AND m.track = p.track AND m.month = p.month"""))
def podium_gap(t):
    return rnd_cols(kpi.podium_gap(penalised(t)))


cte("best", "leagues", "SELECT resource_id, month, user_id AS best_user_id FROM leagues WHERE position = 1 AND track = 'deterministic'")
cte("resid", "aligned", """SELECT resource_id, CAST(date_trunc('month', datetime) AS DATE) AS month, user_id, datetime, observed, value - observed AS residual
  FROM aligned WHERE variable = 'q50'""")
cte("reach", "resid best", """SELECT u.resource_id, u.month, u.user_id, greatest(u.r, coalesce(b.r, u.r)) AS reach FROM
  (SELECT resource_id, month, user_id, max(abs(residual)) AS r FROM resid GROUP BY 1, 2, 3) u
  LEFT JOIN (SELECT r.resource_id, r.month, max(abs(residual)) AS r FROM resid r JOIN best b ON b.resource_id = r.resource_id AND b.month = r.month AND b.best_user_id = r.user_id
    GROUP BY 1, 2) b ON b.resource_id = u.resource_id AND b.month = u.month""")
_BIN = "least(greatest(CAST(floor((r.residual + k.reach) / (2 * k.reach / 19)) AS INTEGER), 0), 18)"
cte("hist", "reach resid best", f"""SELECT resource_id, month, user_id, bin, count(CASE WHEN NOT is_best THEN 1 END) AS u, count(CASE WHEN is_best THEN 1 END) AS b FROM (
  SELECT k.resource_id, k.month, k.user_id, {_BIN} AS bin, false AS is_best FROM reach k JOIN resid r ON r.resource_id = k.resource_id AND r.month = k.month AND r.user_id = k.user_id
  UNION ALL SELECT k.resource_id, k.month, k.user_id, {_BIN}, true FROM reach k JOIN best x ON x.resource_id = k.resource_id AND x.month = k.month
    JOIN resid r ON r.resource_id = k.resource_id AND r.month = k.month AND r.user_id = x.best_user_id) GROUP BY 1, 2, 3, 4""")


def residuals_and_best(t):
    return (stage(kpi.q50_residuals(t.forecasts(), t.measurements()), "residuals"),
            stage(kpi.best_forecaster(kpi.league_assignment(penalised(t))), "best"))


@query(with_ctes("reach hist", f"""SELECT k.resource_id, k.month, k.user_id, g.bin, {rnd('-k.reach + 2 * k.reach / 19 * g.bin')} AS bin_start,
  {rnd('-k.reach + 2 * k.reach / 19 * (g.bin + 1)')} AS bin_end, coalesce(h.u, 0) AS user_count, coalesce(h.b, 0) AS best_count
  FROM reach k CROSS JOIN (SELECT CAST(unnest(generate_series(0, 18)) AS INTEGER) AS bin) g
  LEFT JOIN hist h ON h.resource_id = k.resource_id AND h.month = k.month AND h.user_id = k.user_id AND h.bin = g.bin"""))
def residual_distribution(t):
    return kpi.residual_distribution(*residuals_and_best(t), keep=stage)


cte("levels", "resid", "SELECT resource_id, month, user_id, floor(min(observed)) AS lo, ceil(max(observed)) AS hi FROM resid GROUP BY 1, 2, 3")
_LEVEL = "least(greatest(CAST(ceil((r.observed - k.lo) / ((k.hi - k.lo) / 4)) AS INTEGER), 1), 4)"
cte("level_rows", "levels resid best", f"""SELECT k.resource_id, k.month, k.user_id, {_LEVEL} AS bin, false AS is_best, r.residual * r.residual AS e FROM levels k
    JOIN resid r ON r.resource_id = k.resource_id AND r.month = k.month AND r.user_id = k.user_id
  UNION ALL SELECT k.resource_id, k.month, k.user_id, {_LEVEL}, true, r.residual * r.residual FROM levels k
    JOIN best x ON x.resource_id = k.resource_id AND x.month = k.month
    JOIN resid r ON r.resource_id = k.resource_id AND r.month = k.month AND r.user_id = x.best_user_id WHERE r.observed BETWEEN k.lo AND k.hi""")
cte("level_box", "level_rows", f"""SELECT resource_id, month, user_id, bin, is_best, {box_sql('e')}, count(*) AS n FROM level_rows GROUP BY 1, 2, 3, 4, 5""")


@query(with_ctes("levels level_box", """SELECT k.resource_id, k.month, k.user_id, g.bin, f.is_best, k.lo + (k.hi - k.lo) / 4 * (g.bin - 1) AS level_start,
  k.lo + (k.hi - k.lo) / 4 * g.bin AS level_end, x.min, x.q1, x.median, x.q3, x.max, coalesce(x.n, 0) AS n_samples
  FROM levels k CROSS JOIN (SELECT CAST(unnest(generate_series(1, 4)) AS INTEGER) AS bin) g CROSS JOIN (SELECT unnest([false, true]) AS is_best) f
  LEFT JOIN level_box x ON x.resource_id = k.resource_id AND x.month = k.month AND x.user_id = k.user_id AND x.bin = g.bin AND x.is_best = f.is_best"""))
def mse_by_power_level(t):
    return kpi.mse_by_power_level(*residuals_and_best(t))


@query(with_ctes("filled", f"SELECT {PLAYER}, target_day, {rnd('score', 6)} AS score, is_penalty FROM filled"))
def daily_scores_list(t):
    return report.daily_scores_list(filled(t)).select("resource_id", "track", "month", "user_id", F.inline("daily_scores"))


@query(with_ctes("ranks", f"""SELECT r.resource_id, r.track, r.month, r.user_id, target_day, rank, n.nr AS total_forecasters FROM ranks r
  JOIN (SELECT {BOARD}, count(DISTINCT user_id) AS nr FROM ranks GROUP BY {BOARD}) n ON n.resource_id = r.resource_id AND n.track = r.track AND n.month = r.month"""))
def daily_ranks_list(t):
    r = kpi.daily_ranking(tracked(t))
    return report.daily_ranks_list(r, kpi.participant_count(r)).select("resource_id", "track", "month", "user_id", F.inline("daily_ranks"))


@query(with_ctes("penalised", f"SELECT {PLAYER}, {rnd('a', 6)} AS score FROM penalised WHERE n_days_w_penalties <= 5"))
def month_scores(t):
    return report.month_scores(penalised(t))


cte("report_ranks", "ranks", f"""SELECT {PLAYER}, count(*) AS days_with_submissions, CAST(floor(avg(rank)) AS BIGINT) AS avg_rank_int, min(rank) AS best_rank,
  {_PODIUM} AS podium_count, count(CASE WHEN rank > 10 THEN 1 END) AS rank_11_plus FROM ranks GROUP BY {PLAYER}""")


@query(with_ctes("report_ranks leagues penalised hist filled level_box", f"""SELECT l.resource_id, l.track, l.month, l.user_id, l.league_id, p.n_days_w_penalties, {rnd('p.a', 6)} AS avg_score_w_pen,
  r.days_with_submissions, max(r.days_with_submissions) OVER w AS days_in_period, count(*) OVER w AS nr_participants, r.avg_rank_int, r.best_rank, r.podium_count, r.rank_11_plus,
  dense_rank() OVER (PARTITION BY l.resource_id, l.track, l.month ORDER BY {rnd('p.a', 9)}) AS avg_score_w_pen_rank, d.n_days, {rnd('d.s', 6)} AS day_score_sum, h.n AS histogram_rows, x.n AS boxplot_rows,
  false AS is_fixed_payment, CASE WHEN l.track = 'deterministic' THEN 'rmse' ELSE 'winkler' END AS metric
  FROM leagues l JOIN penalised p USING (resource_id, track, month, user_id) JOIN report_ranks r USING (resource_id, track, month, user_id)
  JOIN (SELECT {PLAYER}, count(*) AS n_days, sum({rnd('score', 6)}) AS s FROM filled GROUP BY {PLAYER}) d USING (resource_id, track, month, user_id)
  LEFT JOIN (SELECT resource_id, 'deterministic' AS track, month, user_id, CAST(sum(u) AS BIGINT) AS n FROM hist GROUP BY ALL) h USING (resource_id, track, month, user_id)
  LEFT JOIN (SELECT resource_id, 'deterministic' AS track, month, user_id, CAST(sum(n) AS BIGINT) AS n FROM level_box WHERE NOT is_best GROUP BY ALL) x USING (resource_id, track, month, user_id)
  WINDOW w AS (PARTITION BY l.resource_id, l.track, l.month)"""))
def monthly_report(t):
    """The nested columns are compared through their sums."""
    f, m = t.forecasts(), t.measurements()
    s = scores(t)
    full = report.monthly_report(s, t.submissions(), f, m, t.participation(), keep=stage)

    def total(column, zero, value):
        return F.aggregate(column, zero, lambda acc, x: acc + value(x))

    zero = F.lit(0).cast("bigint")
    return full.select(
        "resource_id", "track", "month", "user_id", "league_id", "n_days_w_penalties", stable_round(F.col("avg_score_w_pen"), 6).alias("avg_score_w_pen"),
        "days_with_submissions", "days_in_period", "nr_participants", "avg_rank_int", "best_rank", "podium_count", "rank_11_plus", "avg_score_w_pen_rank",
        F.size("daily_scores").cast("bigint").alias("n_days"), stable_round(total("daily_scores", F.lit(0.0), lambda x: x["score"]), 6).alias("day_score_sum"),
        total("residual_distribution", zero, lambda x: x["user_count"]).alias("histogram_rows"),
        total(F.filter("boxplot_by_power", lambda x: ~x["is_best"]), zero, lambda x: x["n_samples"]).alias("boxplot_rows"),
        "is_fixed_payment", "metric",
    )
