"""The monthly report: one row per resource, track, month and forecaster."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumcast.functions import metrics as M
from quorumcast.operators import gates, kpi
from quorumcast.operators.kpi import BOARD, PLAYER
from quorumcast.skew import HEAVY_ROWS
from quorumcast.staging import stage

Keep = Callable[[DataFrame, str], DataFrame]


def daily_scores_list(filled: DataFrame) -> DataFrame:
    """Per forecaster the month's (day, score, is_penalty); at most one entry per day."""
    entry = F.struct("target_day", M.stable_round(F.col("score"), 6).alias("score"), "is_penalty")
    return filled.groupBy(*PLAYER).agg(F.sort_array(F.collect_list(entry)).alias("daily_scores"))


def daily_ranks_list(ranks: DataFrame, participants: DataFrame) -> DataFrame:
    """Per forecaster the month's (day, rank, number of forecasters)."""
    entry = F.struct("target_day", "rank", F.col("nr_participants").alias("total_forecasters"))
    return ranks.join(participants, BOARD).groupBy(*PLAYER).agg(
        F.sort_array(F.collect_list(entry)).alias("daily_ranks")
    )


def month_scores(penalised: DataFrame, max_penalty_days: int = kpi.MAX_PENALTY_DAYS) -> DataFrame:
    """Month comparison of a board: (user, score) of forecasters with few penalty days.

    The list is the same for every forecaster of the board, so it is kept as rows
    under the board's key instead of being copied into each of its report rows.
    """
    return penalised.filter(F.col("n_days_w_penalties") <= max_penalty_days).select(
        *PLAYER, M.stable_round(F.col("avg_score_w_pen"), 6).alias("score")
    )


def league_threshold_lists(thresholds: DataFrame) -> DataFrame:
    """Thresholds of a board as one list per league, at most one entry per day."""
    def entries(league: str):
        return F.sort_array(F.collect_list(F.struct("target_day", M.stable_round(F.col(league), 6).alias("value")))).alias(league)

    lists = thresholds.groupBy(*BOARD).agg(entries("elite"), entries("challenger"), entries("runner_up"))
    return lists.select(*BOARD, F.struct("elite", "challenger", "runner_up").alias("league_thresholds"))


def _histograms(distribution: DataFrame) -> DataFrame:
    entry = F.struct("bin", "bin_start", "bin_end", "user_count", "best_count")
    return distribution.groupBy("resource_id", "month", "user_id").agg(
        F.sort_array(F.collect_list(entry)).alias("residual_distribution")
    )


def _boxplots(levels: DataFrame) -> DataFrame:
    entry = F.struct("bin", "is_best", "level_start", "level_end", "min", "q1", "median", "q3", "max", "n_samples")
    return levels.groupBy("resource_id", "month", "user_id").agg(
        F.sort_array(F.collect_list(entry)).alias("boxplot_by_power")
    )


def monthly_report(
    scores: DataFrame,
    submissions: DataFrame,
    forecasts: DataFrame,
    measurements: DataFrame,
    participation: DataFrame,
    excluded_days: Iterable[str] = (),
    keep: Keep = stage,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """All resources, tracks and months in one job.

    ``keep(df, name)`` holds a result that several branches read, by default by
    writing it once; branches that recompute it would multiply the work.
    """
    clean = gates.drop_partial_submissions(scores, submissions)
    clean = gates.drop_fixed_payment(gates.drop_dates(clean, excluded_days), participation)
    tracked = keep(kpi.track_scores(clean), "track_scores")

    ranks = keep(kpi.daily_ranking(tracked, heavy_rows), "daily_ranks")
    daily = kpi.daily_score_matrix(tracked)
    filled = keep(kpi.penalty_fill(daily, heavy_rows), "filled_scores")
    penalised = keep(kpi.month_score_stats_w_penalty(filled), "penalised")
    leagues = keep(kpi.league_assignment(penalised), "leagues")
    rank_stats = kpi.month_rank_stats(ranks)
    residuals = keep(kpi.q50_residuals(forecasts, measurements), "residuals")
    best = kpi.best_forecaster(leagues)
    histogram = _histograms(kpi.residual_distribution(residuals, best, keep=keep)).withColumn("track", F.lit("deterministic"))
    boxplot = _boxplots(kpi.mse_by_power_level(residuals, best)).withColumn("track", F.lit("deterministic"))
    paid = participation.select("resource_id", "user_id", "is_fixed_payment")

    return (
        penalised.join(kpi.participation_stats(rank_stats).drop("days_with_submissions"), PLAYER)
        .join(kpi.month_score_stats(daily), PLAYER)
        .join(rank_stats, PLAYER)
        .join(kpi.month_rank_w_penalty(penalised, heavy_rows), PLAYER)
        .join(leagues.drop("position"), PLAYER)
        .join(kpi.podium_gap(penalised), PLAYER)
        .join(daily_scores_list(filled), PLAYER)
        .join(daily_ranks_list(ranks, kpi.participant_count(ranks)), PLAYER)
        .join(league_threshold_lists(kpi.league_thresholds(filled)), BOARD)
        .join(histogram, PLAYER, "left")
        .join(boxplot, PLAYER, "left")
        .join(paid, ["resource_id", "user_id"], "left")
        .withColumn("is_fixed_payment", F.coalesce("is_fixed_payment", F.lit(False)))
        .withColumn("metric", F.when(F.col("track") == "deterministic", "rmse").otherwise("winkler"))
    )


def report_as_json(report: DataFrame) -> DataFrame:
    """The nested columns as JSON text, for sinks that cannot hold them."""
    nested = ["daily_scores", "daily_ranks", "league_thresholds", "residual_distribution", "boxplot_by_power"]
    out = report
    for c in nested:
        out = out.withColumn(c, F.to_json(c)).withColumnRenamed(c, f"{c}_json")
    distribution = F.to_json(F.struct("rank_1_5", "rank_6_10", "rank_11_plus"))
    return out.withColumn("rank_distribution_json", distribution).drop("rank_1_5", "rank_6_10", "rank_11_plus")
