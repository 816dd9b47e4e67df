"""Ridge stacking: weights learned by regression of the target on the forecasters.

For every (resource, variable) the centred system ``(X'X + alpha I) w = X'y`` is solved.
Models of up to ``SMALL`` forecasters are solved by their normal equations: a span of
``SPAN`` days of a model is multiplied in one task, the products are added up, and
only their sums, bounded by ``SMALL`` squared, come together.  No resource is gathered in one task.

Larger models are solved by conjugate gradients.  One step needs ``X p`` (a sum over
forecasters per slot) and ``X' q`` (a sum over slots per forecaster): two joins and two
aggregates of the size of the training rows, and never the matrix of all forecaster pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumcast.operators.profiles import is_packed, unpacked
from quorumcast.staging import stage

MODEL = ["resource_id", "variable"]
COEF = [*MODEL, "user_id"]
#: Forecasters of a model that is solved by its normal equations, and days multiplied at once.
SMALL, SPAN = 256, 30


def _training(forecasts: DataFrame, measurements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centred training rows (x per forecaster and slot, y per slot) and the means.

    A slot a forecaster did not submit takes its mean, so it adds nothing to the
    centred sums and needs no row.
    """
    f = forecasts.select(*COEF, "datetime", "value").filter(F.col("value").isNotNull())
    m = measurements.filter(F.col("value").isNotNull()).select("resource_id", "datetime", F.col("value").alias("y"))
    rows = f.join(m, ["resource_id", "datetime"])
    x_mean = rows.groupBy(*COEF).agg(F.avg("value").alias("x_mean"))
    slots = rows.groupBy(*MODEL, "datetime").agg(F.first("y").alias("y"))
    y_mean = slots.groupBy(*MODEL).agg(F.avg("y").alias("y_mean"))
    x = rows.join(x_mean, COEF).join(y_mean, MODEL).select(
        *COEF, "datetime", (F.col("value") - F.col("x_mean")).alias("x"), (F.col("y") - F.col("y_mean")).alias("y")
    )
    return x, x_mean.join(y_mean, MODEL)


class NotConverged(RuntimeError):
    """Conjugate gradients did not reach the tolerance."""


def _products(table: pa.Table) -> pa.Table:
    """Sums over one span of a model.  For each pair of forecasters (i, j): xx, xn, nx, nn of values and numbers of rows;
    for each one (j empty): with the target's sum and number of rows, and its own sum and number; for the model: the target's."""
    of_target = pc.is_null(table.column("user_id"))
    target = table.filter(of_target).column("points").combine_chunks().flatten()
    table = table.filter(pc.invert(of_target))
    points = table.column("points").combine_chunks()
    if len(points) == 0 or len(target) == 0:
        return pa.table({c: pa.array([], pa.string()) for c in ("resource_id", "variable", "i", "j")} | {f"v{k}": pa.array([], pa.float64()) for k in range(4)})
    count = np.diff(points.offsets.to_numpy())
    user = np.repeat(np.arange(len(count)), count)
    flat = points.flatten()
    slot, value = flat.field("datetime").cast(pa.int64()).to_numpy(), flat.field("value").to_numpy()
    when, y = target.field("datetime").cast(pa.int64()).to_numpy(), target.field("value").to_numpy()
    times, first, place = np.unique(when, return_index=True, return_inverse=True)
    n_y, sum_y = np.bincount(place, minlength=len(times)).astype(float), np.bincount(place, y, len(times))
    at = np.minimum(np.searchsorted(times, slot), len(times) - 1)
    known = times[at] == slot
    user, at, value = user[known], at[known], value[known]
    x, n = np.zeros((len(count), len(times))), np.zeros((len(count), len(times)))
    np.add.at(x, (user, at), value)
    np.add.at(n, (user, at), 1.0)
    xs, ns = x * n_y, n * n_y
    i, j = (v.ravel() for v in np.indices((len(count), len(count))))
    pair = np.stack([(xs @ xs.T).ravel(), (xs @ ns.T).ravel(), (ns @ xs.T).ravel(), (ns @ ns.T).ravel()])
    some = (ns @ ns.T).ravel() > 0
    one = np.stack([x @ sum_y, x @ n_y, n @ sum_y, n @ n_y])
    sent = n.any(axis=0)
    whole = np.array([[y[first][sent].sum()], [float(sent.sum())], [0.0], [0.0]])
    names = table.column("user_id").to_pylist()
    rows = len(names)
    left = [names[k] for k in i[some]] + names + [None]
    right = [names[k] for k in j[some]] + [None] * (rows + 1)
    v = np.concatenate([pair[:, some], one, whole], axis=1)
    return pa.table({"resource_id": pa.array([table.column("resource_id")[0].as_py()] * len(left), pa.string()),
                     "variable": pa.array([table.column("variable")[0].as_py()] * len(left), pa.string()),
                     "i": pa.array(left, pa.string()), "j": pa.array(right, pa.string()), **{f"v{k}": pa.array(v[k]) for k in range(4)}})


def _solver(alpha: float):
    def solve(table: pa.Table) -> pa.Table:
        i, j = table.column("i").to_pylist(), table.column("j").to_pylist()
        v = np.stack([table.column(f"v{k}").to_numpy() for k in range(4)], axis=1)
        one = {a: v[r] for r, (a, b) in enumerate(zip(i, j)) if a is not None and b is None and v[r][3] > 0}
        total = next(v[r] for r, a in enumerate(i) if a is None)
        names = sorted(one)
        place = {a: k for k, a in enumerate(names)}
        y_mean = total[0] / total[1] if total[1] else 0.0
        mean = np.array([one[a][1] / one[a][3] for a in names])
        m = np.eye(len(names)) * alpha
        for r, (a, b) in enumerate(zip(i, j)):
            if b is not None:
                p, q = place[a], place[b]
                m[p, q] += v[r][0] - mean[q] * v[r][1] - mean[p] * v[r][2] + mean[p] * mean[q] * v[r][3]
        right = np.array([one[a][0] - y_mean * one[a][1] - mean[place[a]] * (one[a][2] - y_mean * one[a][3]) for a in names])
        coef = np.linalg.lstsq(m, right, rcond=None)[0] if alpha == 0 else np.linalg.solve(m, right)
        keys = {c: pa.array([table.column(c)[0].as_py()] * len(names), pa.string()) for c in MODEL}
        return pa.table({**keys, "user_id": pa.array(names, pa.string()), "coef": pa.array(coef, pa.float64()), "x_mean": pa.array(mean, pa.float64()),
                         "y_mean": pa.array(np.full(len(names), y_mean), pa.float64())})

    return solve


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, span, points) of rows or profiles, the points being known ones; what is packed is sent as it is."""
    of = lambda t: F.floor(F.unix_date(F.to_date(t)) / SPAN)
    if is_packed(rows):
        known = rows.select(*keys, F.filter("points", lambda p: p["value"].isNotNull() & p["datetime"].isNotNull()).alias("points"))
        spans = F.array_distinct(F.transform("points", lambda p: of(p["datetime"])))
        cut = known.withColumn("spans", spans).select(*keys, F.explode("spans").alias("span"), "points", "spans")
        own = F.when(F.size("spans") == 1, F.col("points")).otherwise(F.filter("points", lambda p: of(p["datetime"]) == F.col("span")))
        return cut.select(*keys, "span", own.alias("points"))
    return rows.groupBy(*keys, of(F.col("datetime")).alias("span")).agg(F.collect_list(F.struct("datetime", F.col("value").cast("double").alias("value"))).alias("points"))


def _by_normal_equations(forecasts: DataFrame, observed: DataFrame, models: DataFrame, alpha: float) -> DataFrame:
    """Coefficients of small models.  The target goes to each span of a model once, in a row without a user."""
    target = models.select(*MODEL).join(_listed(observed, "resource_id"), "resource_id")
    both = _listed(forecasts, *COEF).unionByName(target.withColumn("user_id", F.lit(None).cast("string")))
    sums = "resource_id string, variable string, i string, j string, v0 double, v1 double, v2 double, v3 double"
    parts = both.groupBy(*MODEL, "span").applyInArrow(_products, sums)
    cells = parts.groupBy(*MODEL, "i", "j").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    return cells.groupBy(*MODEL).applyInArrow(_solver(alpha), "resource_id string, variable string, user_id string, coef double, x_mean double, y_mean double")


def ridge_coefficients(forecasts: DataFrame, measurements: DataFrame, alpha: float = 1.0, tolerance: float = 1e-28,
                       keep: Callable[[DataFrame, str], DataFrame] = stage, small: int = SMALL) -> DataFrame:
    """(resource_id, variable, user_id, coef, x_mean, y_mean).  Models of more than ``small`` forecasters go by conjugate gradients."""
    rows = unpacked(forecasts).select(*COEF, "datetime", F.col("value").cast("double").alias("value")).na.drop()
    observed = measurements.select("resource_id", "datetime", F.col("value").cast("double").alias("value")).na.drop()
    if alpha < 0:
        return by_conjugate_gradients(rows, observed, alpha, tolerance, keep)
    sizes = keep(rows.select(*COEF).distinct().groupBy(*MODEL).agg(F.count(F.lit(1)).alias("users")), "ridge-sizes")
    form = forecasts.na.drop(subset=COEF) if is_packed(forecasts) else rows
    many, few = sizes.filter(F.col("users") > small).select(*MODEL), sizes.filter(F.col("users") <= small)
    if many.isEmpty():
        return keep(_by_normal_equations(form, observed, few, alpha), "ridge-solved")
    solved = keep(_by_normal_equations(form.join(many, MODEL, "left_anti"), observed, few, alpha), "ridge-solved")
    return solved.unionByName(by_conjugate_gradients(rows.join(many, MODEL, "left_semi"), observed, alpha, tolerance, keep).select(*solved.columns))


def by_conjugate_gradients(forecasts: DataFrame, measurements: DataFrame, alpha: float = 1.0,
                           tolerance: float = 1e-28, keep: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """(resource_id, variable, user_id, coef, x_mean, y_mean).

    Conjugate gradients go on until every model's squared residual is below
    ``tolerance`` of its start; a model that got there keeps its coefficients.  In
    exact arithmetic that takes as many steps as a model has forecasters; rounding
    may need more, and after ten times that number ``NotConverged`` is raised.
    Each step's vectors, one row per forecaster, are written once, which also cuts the lineage.
    """
    x, means = _training(forecasts, measurements)
    x = keep(x, "ridge-rows")
    start = x.groupBy(*COEF).agg(F.sum(F.col("x") * F.col("y")).alias("r"))
    state = keep(start.select(*COEF, F.lit(0.0).alias("w"), "r", F.col("r").alias("p")), "ridge-state")
    norm0 = keep(state.groupBy(*MODEL).agg(F.sum(F.col("r") * F.col("r")).alias("rr0"), F.count(F.lit(1)).alias("size0")), "ridge-norm")
    largest = norm0.agg(F.max("size0")).first()[0] or 0
    step = 0
    while True:
        residual = state.groupBy(*MODEL).agg(F.sum(F.col("r") * F.col("r")).alias("rr")).join(norm0, MODEL)
        if residual.filter(F.col("rr") > F.lit(tolerance) * F.col("rr0")).isEmpty():
            return state.select(*COEF, F.col("w").alias("coef")).join(means, COEF)
        if step >= 10 * largest:
            raise NotConverged(f"ridge models are not solved after {step} steps")
        step += 1
        xp = x.join(state.select(*COEF, "p"), COEF).groupBy(*MODEL, "datetime").agg(F.sum(F.col("x") * F.col("p")).alias("q"))
        back = x.join(xp, [*MODEL, "datetime"]).groupBy(*COEF).agg(F.sum(F.col("x") * F.col("q")).alias("a"))
        vec = keep(state.join(back, COEF).withColumn("a", F.col("a") + F.lit(float(alpha)) * F.col("p")), "ridge-step")
        dots = vec.groupBy(*MODEL).agg(
            F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("a")).alias("pa"),
        ).join(norm0, MODEL)
        going = (F.col("pa") > 0) & (F.col("rr") > F.lit(tolerance) * F.col("rr0"))
        dots = dots.withColumn("size", F.when(going, F.col("rr") / F.col("pa")).otherwise(F.lit(0.0)))
        moved = vec.join(dots.select(*MODEL, "size", F.col("rr").alias("rr_old")), MODEL).select(
            *COEF, (F.col("w") + F.col("size") * F.col("p")).alias("w"), (F.col("r") - F.col("size") * F.col("a")).alias("r"),
            "p", "size", "rr_old")
        # The new residual is summed up afresh: from the old sums it would lose its digits.
        new = moved.groupBy(*MODEL).agg(F.sum(F.col("r") * F.col("r")).alias("rr_new"))
        beta = F.when((F.col("size") > 0) & (F.col("rr_old") > 0), F.col("rr_new") / F.col("rr_old")).otherwise(F.lit(0.0))
        state = keep(moved.join(new, MODEL).select(*COEF, "w", "r", (F.col("r") + beta * F.col("p")).alias("p")), "ridge-state")


def ridge_weights(coefficients: DataFrame) -> DataFrame:
    """Non-negative coefficients, normalised; all zero where none is positive."""
    positive = coefficients.select(*COEF, F.greatest("coef", F.lit(0.0)).alias("_w"))
    total = positive.groupBy(*MODEL).agg(F.sum("_w").alias("_total"))
    w = F.when(F.col("_total") > 0, F.col("_w") / F.col("_total")).otherwise(F.col("_w"))
    return positive.join(total, MODEL).select(*COEF, w.alias("weight"))


def ridge_predict(block: DataFrame, coefficients: DataFrame, lower: float | None = 0.0) -> DataFrame:
    """Regression forecast per slot: intercept plus coefficients times values, with a lower bound."""
    c = coefficients.select(*COEF, "coef", "x_mean", "y_mean")
    term = F.coalesce(F.col("coef") * (F.col("value") - F.col("x_mean")), F.lit(0.0))
    slot = ["resource_id", "challenge_id", "variable", "datetime"]
    if is_packed(block):
        # Coefficients come to where the profiles lie.
        block = block.repartition("challenge_id", "variable")
        own = block.select("challenge_id", *COEF).distinct().join(c, COEF).drop("resource_id")
        known = unpacked(block.join(own, ["challenge_id", "variable", "user_id"]))
    else:
        known = block.join(c, COEF)
    out = known.groupBy(*slot).agg((F.max("y_mean") + F.sum(term)).alias("value"))
    return out if lower is None else out.withColumn("value", F.greatest("value", F.lit(float(lower))))
