"""Outlying forecast profiles within a challenge.

A profile is one forecaster's series of one variable over the challenge.  All
distances are taken to the per-slot median and judged by the median absolute
deviation of the challenge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quorumcast.operators.profiles import is_packed, sized, unpacked
from quorumcast.skew import HEAVY_ROWS, percentile_by
from quorumcast.staging import as_is

Keep = Callable[[DataFrame, str], DataFrame]
BLOCK = ["challenge_id", "variable"]
PROFILE = ["challenge_id", "variable", "user_id"]


def block_bounds(block: DataFrame) -> DataFrame:
    """Smallest and largest value and number of forecasters per (challenge, variable).

    Counting users after a per-user aggregate keeps the map-side combine.
    """
    per_user = block.groupBy(*PROFILE).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return per_user.groupBy(*BLOCK).agg(
        F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.count(F.lit(1)).alias("n_forecasters")
    )


def minmax_normalise(block: DataFrame) -> DataFrame:
    """Profiles scaled to [0, 1] by the block's own range; a constant block has no rows."""
    bounds = block_bounds(block).filter(F.col("hi") > F.col("lo"))
    return block.join(bounds, BLOCK).withColumn(
        "value", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    ).drop("lo", "hi", "n_forecasters")


def median_profile(block: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Median per slot.  A slot has at most one value per forecaster, so the number
    of forecasters, when it is on the rows, bounds the group; profiles are counted for it."""
    if is_packed(block):
        block = sized(block)
    size = "n_forecasters" if "n_forecasters" in block.columns else None
    return percentile_by(unpacked(block), [*BLOCK, "datetime"], "value", {"median": 0.5}, heavy_rows, size=size)


def _dtw_same_shape(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping distance of each row pair of two equally shaped matrices."""
    pairs, n = a.shape
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    best = np.full((n + 1, pairs), np.inf)
    best[0] = 0.0
    for i in range(n):
        row = np.empty_like(best)
        row[0] = np.inf
        for j in range(n):
            gap = a[i] - b[j]
            row[j + 1] = np.minimum(np.minimum(best[j], best[j + 1]), row[j]) + gap * gap
        best = row
    return np.sqrt(best[n])


@F.pandas_udf(DoubleType())
def _dtw(profile: pd.Series, reference: pd.Series) -> pd.Series:
    lengths = profile.map(len)
    out = pd.Series(np.nan, index=profile.index)
    for _, where in lengths.groupby(lengths).groups.items():
        out.loc[where] = _dtw_same_shape(
            np.stack(profile.loc[where].to_list()), np.stack(reference.loc[where].to_list())
        )
    return out


def _sides(block: DataFrame, reference: DataFrame) -> DataFrame:
    return block.filter(F.col("value").isNotNull()).join(reference, [*BLOCK, "datetime"])


def _packed_sides(block: DataFrame, reference: DataFrame) -> DataFrame:
    """Profiles next to the medians of their own slots: one row per block carries the reference."""
    lines = reference.groupBy(*BLOCK).agg(F.sort_array(F.collect_list(F.struct("datetime", "median"))).alias("_ref"))
    known = block.select(*PROFILE, F.filter("points", lambda p: p["value"].isNotNull() & p["datetime"].isNotNull()).alias("_p")).filter(F.size("_p") > 0)
    times = F.transform("_p", lambda p: p["datetime"])
    own = F.when(F.size("_ref") == F.size("_p"), F.col("_ref")).otherwise(F.filter("_ref", lambda r: F.array_contains(times, r["datetime"])))
    return known.join(lines, BLOCK).withColumn("_own", own).select(
        *PROFILE, F.zip_with(F.col("_p.value"), F.col("_own.median"), lambda v, m: F.struct(v.alias("value"), m.alias("median"))).alias("_s"),
        F.array_min("_p.value").alias("_lo"), F.array_max("_p.value").alias("_hi"))


def _extent() -> list[Column]:
    return [F.min("value").alias("_lo"), F.max("value").alias("_hi")]


def dtw_distance(block: DataFrame, reference: DataFrame, keep: Keep = as_is) -> DataFrame:
    """Warping distance of every profile to the reference, scaled by the block's range.

    Scaling both by the same range divides the distance by it, so the range is
    applied to the result.  A list holds one challenge's slots, about a hundred.
    """
    if is_packed(block):
        lists = _packed_sides(block, reference)
    else:
        lists = _sides(block, reference).groupBy(*PROFILE).agg(
            F.array_sort(F.collect_list(F.struct("datetime", "value", "median"))).alias("_s"), *_extent()
        )
    return _scale(lists.select(*PROFILE, _dtw(F.col("_s.value"), F.col("_s.median")).alias("_d"), "_lo", "_hi"), keep)


def euclidean_distance(block: DataFrame, reference: DataFrame, keep: Keep = as_is) -> DataFrame:
    if is_packed(block):
        squares = F.transform("_s", lambda s: (s["value"] - s["median"]) * (s["value"] - s["median"]))
        lists = _packed_sides(block, reference).select(*PROFILE, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("_d"), "_lo", "_hi")
        return _scale(lists, keep)
    gap = F.col("value") - F.col("median")
    return _scale(_sides(block, reference).groupBy(*PROFILE).agg(F.sqrt(F.sum(gap * gap)).alias("_d"), *_extent()), keep)


def _scale(raw: DataFrame, keep: Keep) -> DataFrame:
    """Divide by the range of the block, which follows from the profiles' own extents.

    The unscaled distances are worth keeping: there is one row per profile and not
    per slot, and the median behind them is not worked out again for the range.
    """
    raw = keep(raw, "profile-distances")
    bounds = raw.groupBy(*BLOCK).agg(
        (F.max("_hi") - F.min("_lo")).alias("_span"), F.count(F.lit(1)).alias("n_forecasters")
    )
    distance = F.when(F.col("_span") > 0, F.col("_d") / F.col("_span")).otherwise(F.lit(0.0))
    return raw.join(bounds, BLOCK).select(*PROFILE, "n_forecasters", distance.alias("distance"))


def mad_threshold(distances: DataFrame, alpha: float, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """median(d) + alpha * median(|d - median(d)|) per (challenge, variable)."""
    mid = percentile_by(distances, BLOCK, "distance", {"median_distance": 0.5}, heavy_rows, size="n_forecasters")
    dev = distances.join(mid, BLOCK).withColumn("_dev", F.abs(F.col("distance") - F.col("median_distance")))
    mad = percentile_by(dev, BLOCK, "_dev", {"mad": 0.5}, heavy_rows, size="n_forecasters")
    return mid.join(mad, BLOCK).withColumn("threshold", F.col("median_distance") + F.lit(float(alpha)) * F.col("mad"))


def profile_distances(block: DataFrame, min_forecasters: int = 4, distance: str = "dtw",
                      heavy_rows: int = HEAVY_ROWS, keep: Keep = as_is) -> DataFrame:
    """Distance of each profile of a block with enough forecasters; ``keep`` may hold it for its several readers.

    Blocks with too few forecasters are small and dropped at the end, which saves
    counting them beforehand.
    """
    if distance not in ("dtw", "euclidean"):
        raise ValueError(f"unknown distance: {distance}")
    measure = dtw_distance if distance == "dtw" else euclidean_distance
    found = measure(block, median_profile(block, heavy_rows), keep)
    return keep(found.filter(F.col("n_forecasters") >= min_forecasters), "block-distances")


def detect_outliers(block: DataFrame, alpha: float = 20.0, min_forecasters: int = 4, distance: str = "dtw",
                    heavy_rows: int = HEAVY_ROWS, keep: Keep = as_is) -> DataFrame:
    """(challenge_id, variable, user_id) of outlying profiles.  Lazy unless ``keep`` writes.

    Blocks with fewer than ``min_forecasters``, and constant ones, have none.
    """
    distances = profile_distances(block, min_forecasters, distance, heavy_rows, keep)
    limits = mad_threshold(distances, alpha, heavy_rows).select(*BLOCK, "threshold")
    return distances.join(limits, BLOCK).filter(F.col("distance") > F.col("threshold")).select(*PROFILE)
