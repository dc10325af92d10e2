"""Distributed model fitting on Spark ML.

Reference defaults are the function defaults (20-fold LR, 12- and 9-point GBT
grids with 500-1000 trees, 50-factor model with 100 iterations); callers pass
lighter settings for quick checks.  Parameter translations are documented
approximations:

* sklearn ``C`` <-> Spark ``regParam = 1 / (C * n)`` with
  ``standardization=False`` (sklearn does not standardise), with n the rows
  of the fit at hand: a fold's fit counts the fold's training rows;
* boosted trees are those of :mod:`.boosting`: a node draws ``max_features``
  (a share, one feature at least), ``min_samples_split=2`` is one row per child;
* folds are stratified and number the contests (``stratified_folds``), so a
  refit sees the same folds and mirrored rows never straddle folds (the
  original's are stratified by row); folds are scored by accuracy;
* trees split on binned features (at most 64 bins), sklearn's on exact
  thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..defaults import (BOOST_SUBSAMPLE, BOOST_SUBSAMPLE_FOLDS, BOOST_SUBSAMPLE_GRID, GBT_DEPTH, GBT_FEATURE_SHARE,
                        GBT_GRID_1, GBT_GRID_FOLDS, GBT_GRID_SEED, GBT_RATE, GBT_TREES, LR_C, LR_CV_C_RANGE, LR_CV_FOLDS,
                        LR_CV_NUM_C, SVC_CS, SVC_FOLDS, SVC_FREQUENCIES, SVC_GAMMAS, SVC_SEED)
from . import boosting, lockstep
from .prepare import stratified_folds


def log_grid(lo: float, hi: float, n: int) -> tuple[float, ...]:
    """``n`` values evenly spaced in log10 between ``lo`` and ``hi``."""
    a, b = math.log10(lo), math.log10(hi)
    return tuple(10.0 ** (a + (b - a) * i / (n - 1)) for i in range(n))


LR_CS = log_grid(*LR_CV_C_RANGE, LR_CV_NUM_C)


def class1_probability(pred: DataFrame, out: str = "Pred1") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability").getItem(1))


ROWS_PER_TASK = 20_000


@contextmanager
def held(df: DataFrame):
    """Iterative solvers pass over the data many times: keep one copy for
    the duration of the fit, release it afterwards.  The copy has a partition
    for every ``ROWS_PER_TASK`` rows at most, so that the passes over a small
    table are not all scheduling."""
    d = df.persist(StorageLevel.MEMORY_AND_DISK)
    few = max(1, math.ceil(d.count() / ROWS_PER_TASK))
    if few < d.rdd.getNumPartitions():
        d, whole = d.coalesce(few).persist(StorageLevel.MEMORY_AND_DISK), d
        d.count()
        whole.unpersist(blocking=False)
    try:
        yield d
    finally:
        d.unpersist(blocking=False)


MAX_PARALLEL_FITS = 8


@dataclass
class Search:
    """A finished k-fold search: its points, their mean accuracy over the
    folds, the best point's model refit on all rows and its models of the
    folds."""
    points: list[dict]
    metrics: list[float]
    model: Model
    by_fold: dict[int, Model] = field(default_factory=dict)

    @property
    def best(self) -> int:
        return max(range(len(self.metrics)), key=lambda i: self.metrics[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def grid_points(grid: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def k_fold(data: DataFrame, points: list[dict], make: Callable[[dict, int], Estimator],
           parallelism: int | None = None) -> Search:
    """Fit every point on every fold's training rows (column ``fold``), score
    it by accuracy on the fold, refit the best on all rows.  ``make(point,
    rows)`` gets the number of rows of the fit.  Fits run concurrently (each
    is itself distributed), at most ``MAX_PARALLEL_FITS`` at a time."""
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    folds = [f for f in sorted(sizes) if total > sizes[f]]

    def accuracy(job) -> tuple[float, Model]:
        point, fold = job
        fitted = make(point, total - sizes[fold]).fit(data.where(F.col("fold") != fold))
        hit = fitted.transform(data.where(F.col("fold") == fold)).agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        return float(hit), fitted

    jobs = [(p, f) for p in points for f in folds]
    with ThreadPool(min(parallelism or MAX_PARALLEL_FITS, max(1, len(jobs)))) as pool:
        found = pool.map(accuracy, jobs, chunksize=1)
    n = max(1, len(folds))
    metrics = [sum(hit for hit, _ in found[i * len(folds):(i + 1) * len(folds)]) / n for i in range(len(points))]
    best = max(range(len(points)), key=lambda i: metrics[i])
    own = dict(zip(folds, (m for _, m in found[best * len(folds):(best + 1) * len(folds)])))
    return Search(points, metrics, make(points[best], total).fit(data), own)


def lockstep_search(data: DataFrame, points: list[dict], make: Callable[[dict, int], Estimator],
                    ridge: Callable[[dict, int], float], loss, views=(None,), view: Callable[[dict], int] = lambda p: 0,
                    max_iter: int = 100, after: Callable[[Search, lockstep.Fits, list[int]], object] | None = None):
    """:func:`k_fold` for linear fits, all of them in shared passes
    (:mod:`.lockstep`); the refit is ``make``'s.  ``ridge(point, rows)`` is a
    fit's penalty, ``view(point)`` its feature map of ``views``.  With
    ``after`` the result is what that gives for the search, the fits and the
    best point's numbers among them."""
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    folds = [f for f in sorted(sizes) if total > sizes[f]]
    fits = [lockstep.Fit(view(p), ridge(p, total - sizes[f]), f) for p in points for f in folds]
    # partitions by rows, as many sums come to the driver in a pass
    slots = data.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(total / ROWS_PER_TASK))
    if parts > slots:
        parts = min(3, math.ceil(parts / slots)) * slots          # whole rounds of tasks
    packed = lockstep.pack(data).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = lockstep.fit(packed, fits, sizes, loss, views, max_iter)
        right = found.hits()
        n = max(1, len(folds))
        metrics = [sum(right[i * len(folds) + j] / sizes[f] for j, f in enumerate(folds)) / n for i in range(len(points))]
        best = max(range(len(points)), key=lambda i: metrics[i])
        search = Search(points, metrics, make(points[best], total).fit(data))
        return after(search, found, [best * len(folds) + j for j in range(len(folds))]) if after else search
    finally:
        packed.unpersist(blocking=False)


def logistic(n_rows: int, c: float = LR_C, features: str = "features", label: str = "label") -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(n_rows, 1)),
                              elasticNetParam=0.0, standardization=False, maxIter=100)


def fit_logistic(train: DataFrame, c: float = LR_C, features: str = "features", label: str = "label"):
    with held(train) as data:
        return logistic(data.count(), c, features, label).fit(data)


def fit_logistic_cv(train: DataFrame, cs: Sequence[float] = LR_CS, folds: int = LR_CV_FOLDS) -> Search:
    """Cross-validated logistic regression over ``C`` values."""
    with held(stratified_folds(train, folds)) as data:
        return lockstep_search(data, grid_points({"C": cs}), lambda p, n: logistic(n, p["C"]), lambda p, n: 1.0 / (p["C"] * max(n, 1)),
                               lockstep.log_loss)


def fit_gbt(train: DataFrame, trees: int = GBT_TREES, depth: int = GBT_DEPTH, feature_share: float = GBT_FEATURE_SHARE,
            seed: int = 42) -> boosting.Boosted:
    with held(train) as data:
        return boosting.fit(data, lambda width: boosting.Recipe(
            trees, depth, GBT_RATE, boosting.share_of(feature_share, width), seed=seed))


def fit_gbt_grid(train: DataFrame, grid: dict[str, Sequence] = GBT_GRID_1,
                 folds: int = GBT_GRID_FOLDS) -> boosting.BoostSearch:
    """Grid search over boosted trees with k-fold CV; the best point is refit
    on all rows once."""
    with held(stratified_folds(train, folds)) as data:
        return boosting.search(data, grid_points(grid), lambda p, width: boosting.Recipe(
            p["trees"], p["depth"], GBT_RATE, boosting.share_of(p["feature_share"], width), seed=GBT_GRID_SEED))


def fit_boost_subsample(train: DataFrame, grid: dict[str, Sequence] = BOOST_SUBSAMPLE_GRID,
                        folds: int = BOOST_SUBSAMPLE_FOLDS, **fixed) -> boosting.BoostSearch:
    """Second-order boosted trees with row and column draws and shrinkage,
    grid over depth and least hessian sum of a child."""
    own = {**BOOST_SUBSAMPLE, **fixed}
    with held(stratified_folds(train, folds)) as data:
        return boosting.search(data, grid_points(grid), lambda p, width: boosting.Recipe(
            own["trees"], p["depth"], own["rate"], columns=boosting.share_of(own["column_share"], width), bag=own["bag"],
            second_order=True, l2=own["l2"], min_child=p["min_child_weight"], seed=own["seed"]))


class FourierFeatures(Transformer):
    """Random Fourier features: ``out`` holds cosines and sines of seeded
    normal projections, so that the inner product of two rows estimates the
    kernel ``exp(-gamma |x - y|^2)`` with a standard error of at most
    ``1 / sqrt(2 * frequencies)``.  Built-in expressions only."""

    def __init__(self, gamma: float, width: int, frequencies: int = SVC_FREQUENCIES, seed: int = SVC_SEED,
                 features: str = "features", out: str = "fourier"):
        super().__init__()
        r = np.random.default_rng(seed)
        self.w = (r.normal(0.0, math.sqrt(2 * gamma), (frequencies, width))).tolist()
        self.features, self.out = features, out

    def _transform(self, df: DataFrame) -> DataFrame:
        x, size = vector_to_array(self.features), F.lit(1 / math.sqrt(len(self.w)))
        rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in self.w])
        at = F.transform(rows, lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        both = F.concat(F.transform("_at", lambda v: F.cos(v) * size), F.transform("_at", lambda v: F.sin(v) * size))
        return df.withColumn("_at", at).withColumn(self.out, array_to_vector(both)).drop("_at")


@dataclass
class Calibrated:
    """A search whose margins become probabilities: ``Pred1`` is the logistic
    of ``slope * margin + offset``."""
    search: Search
    slope: float
    offset: float

    @property
    def points(self) -> list[dict]:
        return self.search.points

    @property
    def metrics(self) -> list[float]:
        return self.search.metrics

    @property
    def best(self) -> int:
        return self.search.best

    def transform(self, df: DataFrame, out: str = "Pred1") -> DataFrame:
        z = F.lit(self.slope) * vector_to_array("rawPrediction").getItem(1) + F.lit(self.offset)
        return self.search.transform(df).withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def platt(margins: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the logistic that gives the labels (0/1, column
    ``label``) from ``margin`` with the least log loss, the labels drawn a
    little towards the middle: (n1 + 1) / (n1 + 2) for 1, 1 / (n0 + 2) for 0."""
    row = margins.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = float(row["n1"] or 0), float(row["n0"] or 0)
    if not n1 or not n0:
        return 0.0, math.log((n1 + 1) / (n0 + 1))
    goal = F.when(F.col("label") > 0.5, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
    both = margins.select(array_to_vector(F.array("margin")).alias("m"), F.inline(F.array(
        F.struct(F.lit(1.0).alias("y"), goal.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - goal).alias("w")))))
    with held(both) as data:
        fitted = LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", maxIter=200, tol=1e-12).fit(data)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fit_svc(train: DataFrame, cs: Sequence[float] = SVC_CS, gammas: Sequence[float] = SVC_GAMMAS, folds: int = SVC_FOLDS,
            max_iter: int = 100) -> Calibrated:
    """Support vector machines with the kernel exp(-gamma |x - y|^2) (on
    Fourier features) and without one, every C; probabilities from the margins
    that the best point's models give on the folds they did not see."""
    points = [*grid_points({"kernel": ["rbf"], "gamma": gammas, "C": cs}), *grid_points({"kernel": ["linear"], "C": cs})]
    with held(stratified_folds(train, folds)) as data:
        some = data.select(F.size(vector_to_array("features")).alias("n")).first()
        width = some["n"] if some else 0
        maps = [FourierFeatures(g, width) for g in gammas]

        def ridge(p, n):
            return 1.0 / (p["C"] * max(n, 1))

        def make(p, n):
            svc = LinearSVC(standardization=False, maxIter=max_iter, regParam=ridge(p, n))
            if p["kernel"] == "linear":
                return svc
            return Pipeline(stages=[FourierFeatures(p["gamma"], width), svc.setFeaturesCol("fourier")])

        def calibrated(search, found, own):
            if own:
                return Calibrated(search, *platt(found.margins(own)))
            margin = vector_to_array("rawPrediction").getItem(1).alias("margin")
            return Calibrated(search, *platt(search.model.transform(data).select("label", margin)))

        return lockstep_search(data, points, make, ridge, lockstep.hinge_loss, [*[lockstep.fourier(np.array(m.w)) for m in maps], None],
                               lambda p: gammas.index(p["gamma"]) if p["kernel"] == "rbf" else len(maps), max_iter, calibrated)


#: What a finished search may be; each has points, metrics and a best point.
SEARCHES = (Search, Calibrated, boosting.BoostSearch)


def grid_report(search: Search | Calibrated | boosting.BoostSearch) -> DataFrame:
    """(params, metric, is_best) per grid point of a finished search: the grid
    is small, so its rows are built on the driver."""
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(m), i == search.best)
            for i, (p, m) in enumerate(zip(search.points, search.metrics))]
    return SparkSession.getActiveSession().createDataFrame(rows, "params string, metric double, is_best boolean")


def leaf_stack(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label",
               gbt_kw: dict | None = None) -> tuple[dict[str, DataFrame], dict]:
    """GBT -> one-hot leaves -> LR, and LR on leaves + raw features.

    Returns the scored test frames per model (``Pred1``) and the fitted models.
    Leaves that no row of the fit reaches have slots too; their coefficients
    are 0.
    """
    g = fit_gbt(train, **(gbt_kw or {}))
    tr, te = (g.leaf_vectors(d, "leaves", "combined") for d in (train, test))
    with held(tr) as data:
        n = data.count()
        lr_raw, lr_leaf, lr_comb = (logistic(n, features=x, label=label).fit(data) for x in (features, "leaves", "combined"))
    scored = {
        "gbt": g.transform(test),
        "lr": class1_probability(lr_raw.transform(test)),
        "leaves_lr": class1_probability(lr_leaf.transform(te)),
        "combined_lr": class1_probability(lr_comb.transform(te)),
    }
    return scored, {"gbt": g, "lr": lr_raw, "leaves_lr": lr_leaf, "combined_lr": lr_comb}
