"""Time-series features.

Windows run per series; a series holds one row per slot, so their size is bounded
by the length of the time grid.  Unknown columns are skipped, and without a
column list every numeric column is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Names of powers.
POWER_NAMES = {2: "sqr", 3: "cub", 4: "pow4", 5: "pow5"}
# Rolling statistics and their column suffixes.
ROLLING = {"mean": ("avg", F.avg), "std": ("std", F.stddev_samp), "var": ("var", F.var_samp),
           "min": ("min", F.min), "max": ("max", F.max)}


def _columns(df: DataFrame, columns: Sequence[str] | None, keys: Sequence[str], order: str) -> list[str]:
    if columns is None:
        return [f.name for f in df.schema.fields
                if isinstance(f.dataType, NumericType) and f.name not in (*keys, order)]
    return [c for c in columns if c in df.columns]


def lag_features(df: DataFrame, max_lags: int = 2, columns: Sequence[str] | None = None,
                 keys: Sequence[str] = ("resource_id",), order: str = "datetime") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    out = [F.lag(c, k).over(w).alias(f"{c}_t-{k}")
           for c in _columns(df, columns, keys, order) for k in range(1, max_lags + 1)]
    return df.select(*keys, order, *out)


def difference_features(df: DataFrame, order_n: int = 1, columns: Sequence[str] | None = None,
                        keys: Sequence[str] = ("resource_id",), order: str = "datetime") -> DataFrame:
    """Differences of order 1..n.  Order o is the previous order minus its own lag."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = _columns(df, columns, keys, order)
    out = df
    kept = []
    for c in names:
        previous = c
        for o in range(1, order_n + 1):
            name = f"{c}_diff" if o == 1 else f"{c}_diff{o}"
            out = out.withColumn(name, F.col(previous) - F.lag(previous).over(w))
            kept.append(name)
            previous = name
    return out.select(*keys, order, *kept)


def rolling_features(df: DataFrame, window: int = 2, stats: Sequence[str] = ("mean", "std"),
                     columns: Sequence[str] | None = None, keys: Sequence[str] = ("resource_id",),
                     order: str = "datetime") -> DataFrame:
    """Statistics over the last ``window`` rows, fewer at the start; unknown statistics are ignored."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    out = [ROLLING[s][1](c).over(w).alias(f"{c}_{ROLLING[s][0]}")
           for c in _columns(df, columns, keys, order) for s in stats if s in ROLLING]
    return df.select(*keys, order, *out)


def polynomial_features(df: DataFrame, degree: int = 2, columns: Sequence[str] | None = None,
                        keys: Sequence[str] = ("resource_id",), order: str = "datetime") -> DataFrame:
    out = [F.pow(F.col(c), F.lit(d)).alias(f"{c}_{POWER_NAMES.get(d, f'pow{d}')}")
           for c in _columns(df, columns, keys, order) for d in range(2, degree + 1)]
    return df.select(*keys, order, *out)


def diversity_features(forecasts: DataFrame, quantile: str | None = None,
                       keys: Sequence[str] = ("resource_id", "variable", "datetime")) -> DataFrame:
    """Spread of the forecasters per slot: sample deviation, sample variance and mean."""
    rows = forecasts if quantile is None else forecasts.filter(F.col("variable") == quantile)

    def finite(c):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    return rows.groupBy(*keys).agg(
        finite(F.stddev_samp("value")).alias("forecasters_std"),
        finite(F.var_samp("value")).alias("forecasters_var"),
        finite(F.avg("value")).alias("forecasters_mean"),
    )


class FeatureTransformer:
    """A step that may learn from one table and is applied to another.

    ``learn`` returns what is kept (a small frame of statistics, say), ``apply`` uses it.
    """

    def learn(self, df: DataFrame) -> DataFrame | None:
        return None

    def apply(self, df: DataFrame, learnt: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    _fitted = False

    def fit(self, df: DataFrame) -> FeatureTransformer:
        self._learnt, self._fitted = self.learn(df), True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self._fitted:
            raise ValueError("fit() must come before transform()")
        return self.apply(df, self._learnt)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def run_steps(df: DataFrame, steps: Sequence[FeatureTransformer]) -> DataFrame:
    """Fit and apply the steps one after the other."""
    for step in steps:
        df = step.fit_transform(df)
    return df
