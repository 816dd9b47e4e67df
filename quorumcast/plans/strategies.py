"""Strategies: named, registrable ways to build an ensemble, and running several of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.operators import ensembles as ens
from quorumcast.operators import stacking
from quorumcast.operators.outliers import detect_outliers
from quorumcast.operators.profiles import unpacked
from quorumcast.staging import as_is


class StrategyError(Exception):
    """A strategy could not be built or used."""


class UnknownStrategy(StrategyError):
    pass


@dataclass
class Training:
    """What a strategy may learn from: history before each challenge.

    ``scores`` is (resource_id, challenge_id, variable, user_id, score) of the lookback;
    ``outliers`` is (challenge_id, variable, user_id).  Both may be left out; outliers
    are then detected when a strategy asks, once per block and setting.  ``keep``
    holds what several steps read.
    """

    forecasts: DataFrame | None = None
    measurements: DataFrame | None = None
    challenges: DataFrame | None = None
    scores: DataFrame | None = None
    outliers: DataFrame | None = None
    keep: Callable[[DataFrame, str], DataFrame] = as_is
    _found: dict = field(default_factory=dict)

    def outliers_of(self, block: DataFrame, alpha: float, minimum: int) -> DataFrame:
        if self.outliers is not None:
            return self.outliers
        key = (id(block), alpha, minimum)
        if key not in self._found:
            # The block is held too, so that its id is not given to another.
            self._found[key] = (block, self.keep(detect_outliers(block, alpha, minimum, keep=self.keep), "outliers"))
        return self._found[key][1]


class Strategy:
    """``fit`` turns the training tables into a state table, ``predict`` applies it to a block.

    A strategy that says ``packed`` is given profiles where the caller has them; all others rows.
    """

    packed = False

    def __init__(self, lower: float | None = 0.0, **params):
        self.lower = lower
        self.params = params
        self._fitted = False
        self._state: DataFrame | None = None
        self._training: Training | None = None

    def fit(self, training: Training) -> Strategy:
        self._training = training
        self._state = self.fit_state(training)
        self._fitted = True
        return self

    def predict(self, block: DataFrame) -> DataFrame:
        """(resource_id, challenge_id, variable, datetime, value)."""
        self._check_fitted()
        return ens.clip_lower(self.predict_block(self._form(block), self._state), self.lower)

    def weights(self, block: DataFrame) -> DataFrame:
        self._check_fitted()
        return self.block_weights(self.prepare(self._form(block)), self._state)

    def _form(self, block: DataFrame) -> DataFrame:
        return block if self.packed else unpacked(block)

    def _check_fitted(self) -> None:
        if not self._fitted:
            raise StrategyError("fit() must come before predict()")

    # What a strategy defines.
    def fit_state(self, training: Training) -> DataFrame | None:
        return None

    def prepare(self, block: DataFrame) -> DataFrame:
        return block

    def block_weights(self, block: DataFrame, state: DataFrame | None) -> DataFrame:
        return ens.equal_weights(block)

    def predict_block(self, block: DataFrame, state: DataFrame | None) -> DataFrame:
        kept = self.prepare(block)
        return ens.weighted_sum(kept, self.block_weights(kept, state))


class CombineStrategy(Strategy):
    """Strategy given by one aggregate expression over the forecasters' values of a slot."""

    def combine(self, value: Column) -> Column:
        raise NotImplementedError

    def predict_block(self, block, state):
        return ens.combine(self.prepare(block), self.combine(F.col("value")))


class Registry:
    """Name -> strategy class."""

    def __init__(self):
        self._classes: dict[str, type[Strategy]] = {}

    def register(self, name: str):
        def add(cls: type[Strategy]) -> type[Strategy]:
            if name in self._classes:
                raise StrategyError(f"strategy {name!r} is already registered")
            self._classes[name] = cls
            return cls

        return add

    def get(self, name: str, **params) -> Strategy:
        if name not in self._classes:
            raise UnknownStrategy(f"unknown strategy {name!r}; known: {self.list_strategies()}")
        return self._classes[name](**params)

    def list_strategies(self) -> list[str]:
        return sorted(self._classes)

    def unregister(self, name: str) -> None:
        if name not in self._classes:
            raise UnknownStrategy(f"unknown strategy {name!r}")
        del self._classes[name]

    def is_registered(self, name: str) -> bool:
        return name in self._classes

    def clear(self) -> None:
        self._classes.clear()


registry = Registry()


class _WithoutOutliers(Strategy):
    """Base of strategies that leave outlying profiles out first."""

    packed = True

    def __init__(self, outlier_detection: bool = True, outlier_alpha: float = 20.0,
                 min_forecasters: int = 4, lower: float | None = 0.0, **params):
        super().__init__(lower=lower, **params)
        self.outlier_detection = outlier_detection
        self.outlier_alpha = outlier_alpha
        self.min_forecasters = min_forecasters

    def prepare(self, block):
        if not self.outlier_detection:
            return block
        return ens.drop_outliers(block, self._training.outliers_of(block, self.outlier_alpha, self.min_forecasters))


@registry.register("arithmetic_mean")
class ArithmeticMean(_WithoutOutliers):
    def predict_block(self, block, state):
        return ens.mean_ensemble(self.prepare(block))


@registry.register("weighted_avg")
class WeightedAverage(_WithoutOutliers):
    def __init__(self, beta: float = 0.001, default_score: float = ens.DEFAULT_SCORE, **kw):
        super().__init__(**kw)
        self.beta, self.default_score = beta, default_score

    def fit_state(self, training):
        return training.scores

    def block_weights(self, block, state):
        if state is None:
            return ens.equal_weights(block)
        return ens.exponential_weights(block, state, self.beta, self.default_score, self._training.keep)


@registry.register("best_forecaster")
class BestForecaster(Strategy):
    packed = True

    def fit_state(self, training):
        if training.scores is None:
            raise StrategyError("best_forecaster needs scores to fit")
        return training.scores

    def block_weights(self, block, state):
        return ens.best_forecaster_weights(block, state)

    def predict_block(self, block, state):
        # The chosen series itself: its NULL slots stay NULL.
        chosen = self.block_weights(block, state).select("challenge_id", "variable", "user_id")
        return unpacked(block.join(chosen, ["challenge_id", "variable", "user_id"], "left_semi")).select(*ens.SLOT, "value")


@registry.register("median")
class Median(Strategy):
    packed = True

    def predict_block(self, block, state):
        return ens.median_ensemble(block)


@registry.register("trimmed_mean")
class TrimmedMean(Strategy):
    packed = True

    def predict_block(self, block, state):
        return ens.trimmed_mean_ensemble(block)


@registry.register("fixed_weights")
class FixedWeights(Strategy):
    packed = True

    def __init__(self, weights: dict[str, float] | None = None, **kw):
        super().__init__(**kw)
        self.table = dict(weights or {})

    def block_weights(self, block, state):
        return ens.fixed_weights(block, self.table)


@registry.register("ridge")
class Ridge(Strategy):
    """Stacking by ridge regression on everything known before the fit."""

    packed = True

    def __init__(self, alpha: float = 1.0, **kw):
        super().__init__(**kw)
        self.alpha = alpha

    def fit_state(self, training):
        if training.forecasts is None or training.measurements is None:
            raise StrategyError("ridge needs forecasts and measurements to fit")
        return stacking.ridge_coefficients(training.forecasts, training.measurements, self.alpha)

    def block_weights(self, block, state):
        return ens.members(block).join(stacking.ridge_weights(state), ["resource_id", "variable", "user_id"]).select(*ens.MEMBER, "weight")

    def predict_block(self, block, state):
        return stacking.ridge_predict(block, state, lower=None)


@registry.register("score_weighted")
class ScoreWeighted(Strategy):
    packed = True

    def __init__(self, beta: float = 0.001, **kw):
        super().__init__(**kw)
        self.beta = beta

    def fit_state(self, training):
        if training.scores is None:
            raise StrategyError("score_weighted needs scores to fit")
        return training.scores

    def block_weights(self, block, state):
        return ens.score_normalised_weights(block, state, self.beta, self._training.keep)


@registry.register("inverse_score")
class InverseScore(Strategy):
    packed = True

    def fit_state(self, training):
        return training.scores

    def block_weights(self, block, state):
        return ens.equal_weights(block) if state is None else ens.inverse_score_weights(block, state)


def run_strategies(block: DataFrame, training: Training, names: Sequence[str],
                   params: dict[str, dict] | None = None, strategies: Registry | None = None) -> DataFrame:
    """Predictions of several strategies, told apart by a ``strategy`` column."""
    reg = strategies or registry
    out: DataFrame | None = None
    for name in names:
        instance = reg.get(name, **(params or {}).get(name, {}))
        try:
            part = instance.fit(training).predict(block).withColumn("strategy", F.lit(name))
        except StrategyError:
            raise
        except Exception as e:
            raise StrategyError(f"strategy {name!r} failed: {e}") from e
        part = part.select("strategy", *ens.SLOT, "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise StrategyError("no strategy given")
    return out


def strategy_weights(block: DataFrame, training: Training, names: Sequence[str],
                     params: dict[str, dict] | None = None, strategies: Registry | None = None) -> DataFrame:
    """Forecaster weights of several strategies."""
    reg = strategies or registry
    parts = []
    for name in names:
        fitted = reg.get(name, **(params or {}).get(name, {})).fit(training)
        parts.append(fitted.weights(block).select(F.lit(name).alias("strategy"), *ens.MEMBER, "weight"))
    if not parts:
        raise StrategyError("no strategy given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
