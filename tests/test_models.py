"""Walk-forward models against small exact fits."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.operators import models as MO


def check_loss(q, r):
    return np.mean(np.maximum(q * r, (q - 1) * r))


def linear_program(x, y, q, penalty):
    """The L1 penalised optimum of a linear program lies at a vertex: as many zeros among
    residuals and coefficients as there are unknowns."""
    n, p = x.shape
    z = np.column_stack([x, np.ones(n)])
    walls = np.vstack([z, np.eye(p + 1)[:p]])
    level = np.append(y, np.zeros(p))
    best = (np.inf, None)
    for chosen in combinations(range(n + p), p + 1):
        a = walls[list(chosen)]
        if abs(np.linalg.det(a)) > 1e-9:
            v = np.linalg.solve(a, level[list(chosen)])
            best = min(best, (check_loss(q, y - z @ v) + penalty * np.abs(v[:-1]).sum(), v.tolist()))
    return best


@pytest.mark.parametrize("q", ["q25", "q50", "q75"])
def test_quantile_fit_against_a_linear_program(q):
    rng = np.random.default_rng(4)
    for trial in range(6):
        x = rng.normal(size=(21, 3))
        y = x[:, 0] * 0.8 + 0.1 * x[:, 1] + rng.standard_t(2, size=21)
        z = np.column_stack([x, np.ones(21)])

        def moments(fit):
            flat = MO._sums(z, y, fit)
            m = flat[:-3].reshape(5, 5)
            return MO.Moments(m[:-1, :-1], m[:-1, -1], m[-1, -1], flat[-3:])

        state = MO.QuantileState(q, moments(MO.Fit(q, None, 0.0)))
        for step in range(MO.STEPS):
            state.take(moments(state.fit()))
            if state.settled:
                break
        value, exact = linear_program(x, y, MO.QUANTILES[q], MO.PENALTY)
        got = check_loss(MO.QUANTILES[q], y - z @ state.solution) + MO.PENALTY * np.abs(state.solution[:-1]).sum()
        assert state.settled and value - 1e-9 <= got <= value + 1e-4
        assert ((np.abs(state.solution[:-1]) > 1e-3) == (np.abs(exact[:-1]) > 1e-3)).all()


def test_spline_basis_is_the_cubic_one():
    x = np.array([0.0, 0.25, 0.5, 1.0, 0.125, -3.0, 9.0])
    basis = MO.spline_basis(x, 0.0, 1.0)
    sixth = np.array([1, 4, 1]) / 6
    want = np.zeros((4, 7))
    for row, start in enumerate((0, 1, 2, 4)):
        want[row, start : start + 3] = sixth
    np.testing.assert_allclose(basis[:4], want, atol=1e-12)
    np.testing.assert_allclose(basis[4, :4], np.array([1, 23, 23, 1]) / 48, atol=1e-12)
    np.testing.assert_allclose(basis[5:], basis[[0, 3]], atol=1e-12)
    np.testing.assert_allclose(basis.sum(1), 1.0)
    assert not MO.spline_basis(x, 2.0, 2.0).any()


def table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.normal(), rng.exponential()
        kind = "uvw"[rng.integers(3)] if rng.random() < 0.9 else None
        y = a + np.sin(3 * b) + (kind == "u") + rng.standard_t(2) * 0.3
        rows.append((f"e{i}", i * 8 // n + 1, a, None if rng.random() < 0.1 else b, 7.0, "z" if i > n - 30 else kind, float(y)))
    return rows


SCHEMA = "event_id string, fold long, a double, b double, still double, kind string, y double"


def plain(rows, t):
    """Design of the training and test rows of fold ``t`` in a plain loop."""
    train, held = [r for r in rows if r[1] < t], [r for r in rows if r[1] == t]
    cols = np.array([[np.nan if v is None else v for v in r[2:5]] for r in train], float)
    med = np.nanmedian(cols, axis=0)
    fill = lambda part: np.array([[m if v is None else v for v, m in zip(r[2:5], med)] for r in part], float)
    kinds = sorted({r[5] for r in train if r[5] is not None})
    mode = max(kinds, key=lambda k: (sum(r[5] == k for r in train), [-ord(c) for c in k]))
    hot = lambda part: np.array([[float((r[5] or mode) == k) for k in kinds] for r in part])
    return fill(train), hot(train), np.array([r[6] for r in train]), fill(held), hot(held), [r[0] for r in held]


def test_walk_forward_against_plain_fits(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scored = MO.walk_forward(df, ["a", "b", "still"], ["kind"], "y", "fold", range(3, 9), ["event_id"])
    got = {(r.family, r.event_id): r.score for r in scored.collect()}
    assert len(got) == 6 * sum(r[1] >= 3 for r in rows)
    for t in (3, 8):
        x, hot, y, xt, hott, ids = plain(rows, t)
        mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, zt = (np.column_stack([(m - mean) / scale, h, np.ones(len(m))]) for m, h in ((x, hot), (xt, hott)))
        # Ridge on the standardised basis.
        basis = lambda m: np.hstack([MO.spline_basis(m[:, i], x[:, i].min(), x[:, i].max()) for i in range(3)])
        b, bt = basis(x), basis(xt)
        s = np.where(b.std(0) > 1e-9, b.std(0), 1.0)
        b, bt = (np.column_stack([(m - basis(x).mean(0)) / s, h]) for m, h in ((b, hot), (bt, hott)))
        centre = b.mean(0)
        w = np.linalg.solve((b - centre).T @ (b - centre) + MO.RIDGE * np.eye(b.shape[1]), (b - centre).T @ (y - y.mean()))
        want = (bt - centre) @ w + y.mean()
        np.testing.assert_allclose([got["additive_splines", i] for i in ids], want, atol=1e-6)
        # Huber: no move of the solution or the scale lowers its objective.
        v = np.linalg.lstsq(zt, [got["huber", i] for i in ids], rcond=None)[0] if len(ids) > 20 else None

        def huber(v, scale):
            r = np.abs(y - z @ v)
            inside = r <= MO.EPSILON * scale
            loss = np.where(inside, r**2 / scale, 2 * MO.EPSILON * r - MO.EPSILON**2 * scale).sum() + len(r) * scale
            return loss + MO.ALPHA * (v[:-1] ** 2).sum()

        best = np.append(np.zeros(z.shape[1]), y.std())
        for _ in range(4000):
            r = np.abs(y - z @ best[:-1])
            inside = r <= MO.EPSILON * best[-1]
            weight = np.where(inside, 1.0, MO.EPSILON * best[-1] / r)
            left = (z * weight[:, None]).T @ z + np.diag(np.append(np.full(z.shape[1] - 1, MO.ALPHA * best[-1]), 0))
            best = np.append(np.linalg.lstsq(left, z.T @ (weight * y), rcond=None)[0], np.sqrt((r[inside] ** 2).sum() / (len(r) - (~inside).sum() * MO.EPSILON**2)))
        np.testing.assert_allclose([got["huber", i] for i in ids], zt @ best[:-1], atol=1e-3)
        middle = [np.median([got[f"quantile_q{k}", i] for k in (25, 50, 75)]) for i in ids]
        np.testing.assert_allclose([got["quantile", i] for i in ids], middle)
        assert v is None or huber(best[:-1], best[-1]) <= huber(v, best[-1]) + 1e-3


def test_prefix_medians(spark):
    rows = table(300)
    long = [(p, r[1], r[2 + p]) for r in rows for p in (0, 1, 2) if r[2 + p] is not None]
    df = spark.createDataFrame(long, "predictor int, fold long, x double").repartition(4)
    tests = spark.createDataFrame([(t,) for t in range(1, 10)], "test long")
    got = {(r.predictor, r.test): r.median for r in MO.prefix_medians(df, tests).collect()}
    want = {(p, t): float(np.median(v)) for p in (0, 1, 2) for t in range(1, 10) if (v := [x for q, f, x in long if q == p and f < t])}
    assert got == pytest.approx(want)


def test_no_earlier_rows_no_scores(spark):
    df = spark.createDataFrame(table(40), SCHEMA)
    empty = MO.walk_forward(df.where(F.col("fold") == 8), ["a", "b"], ["kind"], "y", "fold", range(3, 9), ["event_id"])
    assert empty.count() == 0 and set(empty.columns) == {"event_id", "fold", "family", "score"}
    with pytest.raises(ValueError, match="more than"):
        wide = df.withColumn("kind", F.concat(F.lit("k"), F.monotonically_increasing_id()))
        old, MO.LEVELS = MO.LEVELS, 5
        try:
            MO.walk_forward(wide, ["a"], ["kind"], "y", "fold", range(3, 9), ["event_id"])
        finally:
            MO.LEVELS = old


def test_a_category_of_many_levels_is_fitted_without_dense_columns(spark):
    rows = [(e, f, a, b, s, f"i{i % 1501}", y) for i, (e, f, a, b, s, _, y) in enumerate(table(3100))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scored = MO.walk_forward(df, ["a", "b", "still"], ["kind"], "y", "fold", [8], ["event_id"])
    got = {(r.family, r.event_id): r.score for r in scored.collect()}
    x, hot, y, xt, _, ids = plain(rows, 8)
    kinds = sorted({r[5] for r in rows if r[1] < 8})
    hott = np.array([[float(r[5] == k) for k in kinds] for r in rows if r[1] == 8])
    basis = lambda m: np.hstack([MO.spline_basis(m[:, i], x[:, i].min(), x[:, i].max()) for i in range(3)])
    b, bt = basis(x), basis(xt)
    s = np.where(b.std(0) > 1e-9, b.std(0), 1.0)
    b, bt = (np.column_stack([(m - basis(x).mean(0)) / s, h]) for m, h in ((b, hot), (bt, hott)))
    centre = b.mean(0)
    w = np.linalg.solve((b - centre).T @ (b - centre) + MO.RIDGE * np.eye(b.shape[1]), (b - centre).T @ (y - y.mean()))
    np.testing.assert_allclose([got["additive_splines", i] for i in ids], (bt - centre) @ w + y.mean(), atol=1e-6)
    assert len(got) == 6 * len(ids) and np.isfinite(list(got.values())).all()
