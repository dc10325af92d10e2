"""Kernel features and calibrated margins."""

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rivalry.operators import models


def ring(spark, n=240, seed=4):
    """Labels by distance from the middle: no line parts them."""
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, (n, 2))
    y = (np.hypot(*x.T) < 1.2).astype(float)
    rows = [(2000, i, 10_000 + i, [float(a), float(b)], float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "Season int, TeamID1 long, TeamID2 long, x array<double>, label double")
    return d.withColumn("features", array_to_vector("x")), x, y


def test_fourier_features_estimate_the_kernel(spark):
    d, x, _ = ring(spark, 60)
    for gamma, m in ((0.5, 400), (1e-3, 64)):
        z = models.FourierFeatures(gamma, 2, frequencies=m).transform(d).select("TeamID1", vector_to_array("fourier").alias("z"))
        z = np.array([r.z for r in z.orderBy("TeamID1").collect()])
        exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        error = z @ z.T - exact
        assert np.abs(np.diag(error)).max() < 1e-9 and z.shape[1] == 2 * m
        assert error.std() < 1 / math.sqrt(2 * m) and np.abs(error).max() < 5 / math.sqrt(2 * m)


def test_kernel_beats_the_line_and_is_calibrated(spark):
    d, _, y = ring(spark)
    found = models.fit_svc(d, cs=(10.0,), gammas=(1.0, 1e-4), folds=3, max_iter=40)
    assert [p["kernel"] for p in found.points] == ["rbf", "rbf", "linear"]
    assert found.points[found.best] == {"kernel": "rbf", "gamma": 1.0, "C": 10.0}
    assert found.metrics[0] > 0.85 > found.metrics[2]
    p = {r.TeamID1: r.Pred1 for r in found.transform(d).select("TeamID1", "Pred1").collect()}
    loss = -np.mean([math.log(p[i] if t else 1 - p[i]) for i, t in enumerate(y)])
    assert loss < 0.45 and found.slope > 0


def newton(m, y):
    """Platt's fit by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.zeros(2), np.stack((m, np.ones(len(m))), 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x + 1e-12 * np.eye(2), x.T @ (p - t))
    return w


def test_platt_equals_newton(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=300)
    y = (r.random(300) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(float)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, y)], "margin double, label double")
    assert np.allclose(models.platt(d), newton(m, y), atol=1e-4)
    assert models.platt(d.where("label = 1"))[0] == 0.0
    # margins that part the labels: the drawn-in targets keep the fit finite
    sure = d.withColumn("margin", F.when(F.col("label") > 0, 1.0).otherwise(-1.0))
    slope, offset = models.platt(sure)
    assert 0 < slope < 20


def test_calibration_uses_margins_of_unseen_folds(spark):
    d, _, _ = ring(spark, 90)
    with models.held(models.stratified_folds(d, 3)) as data:
        search = models.k_fold(data, [{"C": 1.0}], lambda p, n: models.LinearSVC(maxIter=5, regParam=1 / n))
        assert sorted(search.by_fold) == [0, 1, 2]
        for f, m in search.by_fold.items():
            again = models.LinearSVC(maxIter=5, regParam=1 / data.where(F.col("fold") != f).count()).fit(data.where(F.col("fold") != f))
            assert np.allclose(m.coefficients.toArray(), again.coefficients.toArray(), atol=1e-6)
