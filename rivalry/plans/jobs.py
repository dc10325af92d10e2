"""The tournament job with a fitted model, one function per model family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import HOLDOUT_TEST_PCT, LEAF_LR_FOLDS
from ..operators import complete, models
from ..operators.metrics import roc_auc
from ..operators.prepare import holdout_split
from .tournament import Tournament

Fitter = Callable[[DataFrame], object]


def fit_union(featured: DataFrame, fit: Fitter):
    """Fit on the training rows of the feature union."""
    return fit(featured.where(F.col("is_train")))


def score_union(featured: DataFrame, model, probability=models.class1_probability) -> DataFrame:
    """Score every row of the union (``Pred1``); a row without a feature
    vector keeps NULL and is completed by the fallback."""
    scored = probability(model.transform(featured.where(F.col("features").isNotNull())))
    rest = featured.where(F.col("features").isNull()).withColumn("Pred1", F.lit(None).cast("double"))
    return scored.select(*rest.columns).unionByName(rest)


def _scored(d: DataFrame) -> DataFrame:
    """For models whose ``transform`` gives ``Pred1`` itself."""
    return d


FITTERS: dict[str, tuple[Callable[..., Fitter], Callable]] = {
    "lr": (lambda **kw: (lambda d: models.fit_logistic(d, **kw)), models.class1_probability),
    "lr_cv": (lambda **kw: (lambda d: models.fit_logistic_cv(d, **kw)), models.class1_probability),
    "gbt": (lambda **kw: (lambda d: models.fit_gbt(d, **kw)), _scored),
    "gbt_grid": (lambda **kw: (lambda d: models.fit_gbt_grid(d, **kw)), _scored),
    "gbt_subsample": (lambda **kw: (lambda d: models.fit_boost_subsample(d, **kw)), _scored),
    "svc": (lambda **kw: (lambda d: models.fit_svc(d, **kw)), _scored),
}


def fit_model(t: Tournament, model: str = "lr", **kw):
    """The fitted model (or search) of a family, without completing a table."""
    return fit_union(t.featured, FITTERS[model][0](**kw))


def tournament_predictions(t: Tournament, model: str = "lr", **kw) -> tuple[DataFrame, object]:
    """Complete prediction table (ID, Pred) with the chosen model family."""
    fitted = fit_model(t, model, **kw)
    return complete.submission(t.complete(score_union(t.featured, fitted, FITTERS[model][1]))), fitted


def leaf_stack_predictions(t: Tournament, gbt_kw: dict | None = None, cs=models.LR_CS, folds: int = LEAF_LR_FOLDS):
    """Complete prediction table (ID, Pred) of the logistic regression on tree
    leaves and raw features, its C chosen by k-fold search."""
    ready = t.featured.where(F.col("features").isNotNull())
    combined = models.fit_gbt(ready.where("is_train"), **(gbt_kw or {})).leaf_vectors(ready, "leaves", "combined")
    search = models.fit_logistic_cv(combined.where("is_train").withColumn("features", F.col("combined")), cs, folds)
    scored = models.class1_probability(search.transform(combined.withColumn("features", F.col("combined"))))
    rest = t.featured.where(F.col("features").isNull()).withColumn("Pred1", F.lit(None).cast("double"))
    cols = ["Season", "TeamID1", "TeamID2", "is_train", "Pred1"]
    return complete.submission(t.complete(scored.select(*cols).unionByName(rest.select(*cols)))), search


def leaf_stack_report(t: Tournament, test_pct: int = HOLDOUT_TEST_PCT, gbt_kw: dict | None = None) -> DataFrame:
    """Hold-out AUC of GBT, LR, LR on GBT leaves and LR on leaves + features
    over the training rows (deterministic 70/30 split by contest key):
    (model, auc)."""
    data = holdout_split(t.featured.where(F.col("is_train")), test_pct)
    train, test = data.where(~F.col("is_holdout")), data.where(F.col("is_holdout"))
    scored, _ = models.leaf_stack(train, test, gbt_kw=gbt_kw)
    parts = [roc_auc(s.select("label", "Pred1"), "label", "Pred1").select(F.lit(name).alias("model"), "auc")
             for name, s in scored.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def season_auc(t: Tournament, test_pct: int = HOLDOUT_TEST_PCT) -> DataFrame:
    """Hold-out AUC of the logistic regression with the contests' own
    statistics as training features, which know the result, and with those of
    earlier seasons, which do not: (train_features, rows, auc)."""
    parts = []
    for mode in ("contest", "prior_season"):
        own = t.with_features(mode).featured
        data = holdout_split(own.where(F.col("is_train") & F.col("features").isNotNull()), test_pct)
        train, test = data.where(~F.col("is_holdout")), data.where(F.col("is_holdout"))
        scored = models.class1_probability(models.fit_logistic(train).transform(test))
        parts.append(roc_auc(scored.select("label", "Pred1"), "label", "Pred1")
                     .select(F.lit(mode).alias("train_features"), F.lit(test.count()).cast("long").alias("rows"), "auc"))
    return parts[0].unionByName(parts[1])
