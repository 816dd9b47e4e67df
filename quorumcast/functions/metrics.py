"""Forecast error measures as Spark columns.

Row-level losses (``*_obs``) and their aggregate forms.  Everything here is a
plain ``Column`` expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = ("q10", "q50", "q90")
SCORE_DIGITS = 3
WINKLER_ALPHA = 0.2


def stable_round(c: Column, digits: int = SCORE_DIGITS) -> Column:
    """Round half-up after dropping floating point noise beyond the 9th decimal.

    Sums of doubles depend on the order in which partitions are merged; the
    inner rounding keeps exact ties from flipping with that order.
    """
    return F.round(F.round(c, 9), digits)


def quantile_level(variable: Column) -> Column:
    """``q10`` -> 0.10; any other kind of name is an error.

    The usual quantiles are compared directly, which is far cheaper per row than
    taking the name apart.
    """
    digits = F.regexp_extract(variable, r"^[qQ](\d+)$", 1)
    parsed = F.when(digits != "", F.try_to_number(digits, F.lit("999")).cast("double") / 100).otherwise(
        F.raise_error(F.concat(F.lit("not a quantile name: "), F.coalesce(variable, F.lit("NULL")))).cast("double")
    )
    level = F
    for q in QUANTILES:
        level = level.when(variable == q, F.lit(int(q[1:]) / 100))
    return level.otherwise(parsed)


def pinball_obs(observed: Column, forecast: Column, level: Column | float) -> Column:
    q = level if isinstance(level, Column) else F.lit(float(level))
    diff = observed - forecast
    return F.when(diff > 0, q * diff).otherwise((q - 1) * diff)


def squared_error_obs(observed: Column, forecast: Column) -> Column:
    diff = observed - forecast
    return diff * diff


def absolute_error_obs(observed: Column, forecast: Column) -> Column:
    return F.abs(observed - forecast)


def winkler_obs(lower: Column, upper: Column, observed: Column, alpha: float = WINKLER_ALPHA) -> Column:
    """Interval width plus a penalty for misses; NULL if any input is NULL."""
    rate = F.lit(2.0 / alpha)
    below = F.when(observed < lower, rate * (lower - observed)).otherwise(F.lit(0.0))
    above = F.when(observed > upper, rate * (observed - upper)).otherwise(F.lit(0.0))
    return F.when(
        lower.isNotNull() & upper.isNotNull() & observed.isNotNull(), (upper - lower) + below + above
    )


# Aggregates.  Pairs with a missing side give a NULL loss, and avg() skips it.
def rmse(observed: Column, forecast: Column, digits: int = SCORE_DIGITS) -> Column:
    return stable_round(F.sqrt(F.avg(squared_error_obs(observed, forecast))), digits)


def mse(observed: Column, forecast: Column, digits: int = SCORE_DIGITS) -> Column:
    return stable_round(F.avg(squared_error_obs(observed, forecast)), digits)


def mae(observed: Column, forecast: Column, digits: int = SCORE_DIGITS) -> Column:
    return stable_round(F.avg(absolute_error_obs(observed, forecast)), digits)


def pinball(observed: Column, forecast: Column, level: Column | float, digits: int = SCORE_DIGITS) -> Column:
    return stable_round(F.avg(pinball_obs(observed, forecast, level)), digits)


def winkler(lower: Column, upper: Column, observed: Column,
            alpha: float = WINKLER_ALPHA, digits: int = SCORE_DIGITS) -> Column:
    return stable_round(F.avg(winkler_obs(lower, upper, observed, alpha)), digits)
