"""Fits in lock-step against fits one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rivalry.operators import lockstep, models

FOLDS = 3


def table(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    x = np.stack((r.normal(size=n), 5 * r.random(n), r.integers(0, 2, n), np.ones(n)), 1)
    y = (r.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 2 + x[:, 2])))).astype(float)
    fold = np.arange(n) % FOLDS
    rows = [([float(v) for v in a], float(b), int(c)) for a, b, c in zip(x, y, fold)]
    d = spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(3)
    return d.withColumn("features", array_to_vector("x")), x, y, fold


def test_blocks_hold_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lockstep, "CHUNK", 40)
    d, x, y, fold = table(spark, 150)
    got = [lockstep._unpacked(bytes(r.block)) for r in lockstep.pack(d).collect()]
    assert len(got) >= 3
    found = sorted([*a, b, c] for m in got for a, b, c in zip(*m))
    assert found == sorted([*a, b, c] for a, b, c in zip(x, y, fold))


def test_logistic_fits_equal_newton(spark):
    d, x, y, fold = table(spark)
    fits = [lockstep.Fit(0, 1 / (c * 200), f) for c in (0.01, 1.0, 100.0) for f in (0, 2)] + [lockstep.Fit(0, 1 / 300)]
    found = lockstep.fit(lockstep.pack(d), fits, {f: 100 for f in range(FOLDS)}, lockstep.log_loss, tol=1e-12)
    for f, w in zip(fits, found.weights):
        own = fold != f.fold
        z, t, v = np.c_[x[own], np.ones(own.sum())], y[own], np.zeros(5)
        ridge = np.append(np.full(4, f.ridge * len(t)), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ v))
            v -= np.linalg.solve(z.T * (p * (1 - p)) @ z + np.diag(ridge) + 1e-12 * np.eye(5), z.T @ (p - t) + ridge * v)
        assert np.abs(z @ v - z @ w).max() < 1e-3
    own = [k for k, f in enumerate(fits) if f.fold == 2]
    for k, right in enumerate(found.hits()):
        m = fold == fits[k].fold
        assert right == int((((x[m] @ found.weights[k][:-1] + found.weights[k][-1]) > 0) == (y[m] > 0.5)).sum())
    margins = sorted((r.label, r.margin) for r in found.margins(own[:1]).collect())
    w = found.weights[own[0]]
    assert np.allclose(margins, sorted(zip(y[fold == 2], x[fold == 2] @ w[:-1] + w[-1])))


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_hinge_is_no_higher_than_linear_svc(spark, c):
    from pyspark.ml.classification import LinearSVC
    d, x, y, _ = table(spark)
    ridge = 1 / (c * len(y))
    w = lockstep.fit(lockstep.pack(d), [lockstep.Fit(0, ridge)], {0: len(y)}, lockstep.hinge_loss).weights[0]
    m = LinearSVC(standardization=False, maxIter=100, regParam=ridge).fit(d)

    def loss(w, b):
        return np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + ridge / 2 * w @ w
    assert loss(w[:-1], w[-1]) <= loss(m.coefficients.toArray(), m.intercept) * 1.02


def test_fourier_view_is_the_transformer(spark):
    d, x, _, _ = table(spark, 20)
    t = models.FourierFeatures(0.5, 4, frequencies=8)
    from pyspark.ml.functions import vector_to_array
    got = np.array(sorted(r.z for r in t.transform(d).select(vector_to_array("fourier").alias("z")).collect()))
    assert np.allclose(got, sorted(lockstep.fourier(np.array(t.w))(x).tolist()))


def test_searches_take_no_fit_per_point_and_fold(spark, monkeypatch):
    """One estimator is fitted, the refit (there was one per point and fold);
    the accuracies are those of fits one by one."""
    d, *_ = table(spark)
    d = d.select("*", F.lit(2000).alias("Season"), F.monotonically_increasing_id().alias("TeamID1"),
                 (F.monotonically_increasing_id() + 10 ** 12).alias("TeamID2")).localCheckpoint()
    fitted, plain = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, *a: fitted.append(1) or plain(self, *a))
    search = models.fit_logistic_cv(d, cs=(1e-4, 1e-2, 1.0), folds=3)
    assert len(fitted) == 1
    with models.held(models.stratified_folds(d, 3)) as data:
        again = models.k_fold(data, search.points, lambda p, n: models.logistic(n, p["C"]))
    assert np.allclose(search.metrics, again.metrics, atol=0.011) and search.best == again.best


def test_a_block_holds_each_combination_of_indicators_once(spark, monkeypatch):
    import pickle
    monkeypatch.setattr(lockstep, "SLICE", 16)
    d, x, y, fold = table(spark, 150)
    for row in lockstep.pack(d).collect():
        kinds = pickle.loads(bytes(row.block))[1]
        assert len(kinds) <= 2                          # an indicator and a constant; there was one a row
        rows, y, f = lockstep._rows(bytes(row.block))
        x, w = rows.dense(), np.linspace(-1, 1, 12).reshape(4, 3)
        assert np.allclose(rows.times(w), x @ w) and np.allclose(rows.summed(x @ w), x.T @ (x @ w))
        z, keep = 40 * (x @ w)[:16], (np.arange(len(y)) % 3 > 0)[:16, None] & np.ones((1, 3), bool)
        value, slope = lockstep.log_loss(z, y[:16], keep)
        assert np.allclose(value, np.where(keep, np.logaddexp(0, z) - z * y[:16, None], 0).sum(0))
        assert np.allclose(slope, np.where(keep, 1 / (1 + np.exp(-z)) - y[:16, None], 0))
    plain = lockstep.pack(d.withColumn("features", array_to_vector(F.array(F.get("x", F.lit(0)))))).first()
    assert lockstep._unpacked(bytes(plain.block))[0].shape[1] == 1     # no indicator at all


def test_views_in_slices_are_whole_views(spark, monkeypatch):
    d, *_ = table(spark, 150)
    view = lockstep.fourier(np.random.default_rng(2).normal(size=(8, 4)))
    fits = [lockstep.Fit(0, 1e-2, f) for f in (0, 1)]
    found = []
    for rows in (512, 7):
        monkeypatch.setattr(lockstep, "VIEWED", rows)
        found.append(lockstep.fit(lockstep.pack(d), fits, {f: 50 for f in range(FOLDS)}, lockstep.log_loss, [view], tol=1e-10))
    assert np.allclose(found[0].weights, found[1].weights, atol=1e-4) and found[0].hits() == found[1].hits()


def test_a_small_kernel_is_a_few_polynomials(spark):
    """Values and sums of the series are those of cosines and sines, computed for
    every row and frequency before; a wide kernel or rows without common
    indicators keep those."""
    r = np.random.default_rng(4)
    x = np.stack((r.random(900), 3 * r.random(900) - 1, 0.9999 * r.integers(0, 2, 900), np.ones(900), 2.0 * r.integers(0, 2, 900)), 1)
    d = spark.createDataFrame([([float(v) for v in a], 1.0, 0) for a in x], "x array<double>, label double, fold int")
    packed = lockstep.pack(d.withColumn("features", array_to_vector("x")).coalesce(1)).first().block
    rows, _, _ = lockstep._rows(bytes(packed))
    assert len(rows.rest) == 2 and len(rows.kinds) == 4            # two values, be they 0 and 1 or not
    view = lockstep.fourier(np.array(models.FourierFeatures(1e-3, 5, frequencies=64).w))
    smooth, whole = view.smooth(rows, {}), view(rows.dense())
    assert smooth.x.shape[1] < 64
    w = r.normal(size=(128, 3))
    assert np.allclose(smooth.times(w), whole @ w, atol=1e-11) and np.allclose(smooth.summed(whole @ w), whole.T @ (whole @ w), atol=1e-9)
    assert lockstep.fourier(50 * view.w).smooth(rows, {}) is None
    few = lockstep.Rows(rows.bits, np.repeat(np.packbits(np.eye(3, dtype=bool), axis=1), 300, 0), np.ones(900, int), rows.rest, rows.x,
                        np.array([[0.0] * 3, [1.0] * 3]))
    assert view.smooth(few, {}) is None
