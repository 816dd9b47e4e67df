import random

import numpy as np
import pytest
from helpers import block, hours, series

from quorumcast.operators import stacking


def test_ridge_against_direct_solution(spark):
    rnd = random.Random(5)
    truth = [rnd.uniform(0, 100) for _ in range(20)]
    values = {f"u{i}": [v + rnd.gauss(0, 5 * (i + 1)) for v in truth] for i in range(4)}
    b = block(spark, values)
    m = series(spark, [("r1", t, v) for t, v in zip(hours(20), truth)], "resource_id string, datetime string, value double")
    X, y = np.array([values[u] for u in sorted(values)]).T, np.array(truth)
    Xc, yc = X - X.mean(axis=0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + np.eye(4), Xc.T @ yc)
    coefficients = stacking.ridge_coefficients(b, m, alpha=1.0)
    got = {r.user_id: r.coef for r in coefficients.collect()}
    assert [got[u] for u in sorted(values)] == pytest.approx(list(want), rel=1e-6, abs=1e-8)
    weights = {r.user_id: r.weight for r in stacking.ridge_weights(coefficients).collect()}
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0
    made = [r.value for r in stacking.ridge_predict(b, coefficients).orderBy("datetime").collect()]
    assert made == pytest.approx(list(np.maximum(Xc @ want + y.mean(), 0)), rel=1e-6)


def test_many_nearly_collinear_forecasters(spark):
    rnd = random.Random(6)
    truth = [rnd.uniform(0, 100) for _ in range(60)]
    values = {f"u{i:02d}": [v + rnd.gauss(0, 0.5) for v in truth] for i in range(40)}
    times = [f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00" for i in range(60)]
    rows = [("r1", "c1", u, "q50", t, v) for u, vs in values.items() for t, v in zip(times, vs)]
    b = series(spark, rows, "resource_id string, challenge_id string, user_id string, variable string, datetime string, value double")
    m = series(spark, [("r1", t, v) for t, v in zip(times, truth)], "resource_id string, datetime string, value double")
    X, y = np.array([values[u] for u in sorted(values)]).T, np.array(truth)
    Xc, yc = X - X.mean(axis=0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + np.eye(40), Xc.T @ yc)
    got = {r.user_id: r.coef for r in stacking.ridge_coefficients(b, m).collect()}
    assert [got[u] for u in sorted(values)] == pytest.approx(list(want), rel=1e-6, abs=1e-8)


def test_small_and_large_models_and_both_forms_agree(spark):
    """Normal equations (rows, profiles) and conjugate gradients, over two spans, with gaps, repeated rows and a series of its own."""
    from quorumcast.operators.profiles import pack

    rnd, rows, target = random.Random(8), [], []
    for d in (3, 28, 29, 30):
        for h in range(24):
            t, y = f"2024-01-{d:02d} {h:02d}:00:00", rnd.uniform(0, 100)
            if rnd.random() > 0.1:
                target.append(("r1", t, y))
            rows += [("r1", f"c{d}", f"u{i}", "q50", t, None if rnd.random() < 0.1 else y + rnd.gauss(0, 5 * (i + 1))) for i in range(4) if rnd.random() > 0.1]
            rows += [("r1", f"c{d}", "u0", "q10", t, 0.5 * y)]
    rows.append(("r2", "c", "u0", "q50", "2024-01-03 00:00:00", 1.0))  # never measured
    columns = "resource_id string, challenge_id string, user_id string, variable string, datetime string, value double"
    m = series(spark, target, "resource_id string, datetime string, value double")

    def solved(f, **options):
        return {(r.resource_id, r.variable, r.user_id): (r.coef, r.x_mean, r.y_mean) for r in stacking.ridge_coefficients(f, m, **options).collect()}

    def agree(got, want):
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-9) for k in want)

    single = series(spark, rows, columns)
    want = solved(single, small=0)
    assert len(want) == 5
    agree(solved(single), want)
    agree(solved(single, small=1), want)  # q10 by normal equations, q50 by conjugate gradients
    packed = pack(single, 60)
    agree(solved(packed), want)
    twice = series(spark, rows + rows[:7], columns)
    agree(solved(twice), solved(twice, small=0))
    coefficients = stacking.ridge_coefficients(single, m)
    made = [[(*r[:4], round(r[4], 9)) for r in sorted(map(tuple, stacking.ridge_predict(x, coefficients).filter("value IS NOT NULL").collect()))] for x in (single, packed)]
    assert made[0] == made[1]
