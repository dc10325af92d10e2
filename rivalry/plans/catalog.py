"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query derives its inputs from the parquet tables under ``sf_dir``
(see :mod:`rivalry.sources.fixtures`) and runs over the whole tables.  Where
the pipeline needs model output, the relational queries use a deterministic
stand-in model (``Pred1`` = the row's ``Score_Pct``) so an SQL oracle can
repeat them; the model queries (at the end) fit real Spark ML estimators,
and the checks after them state properties of the fits that SQL can tell.

Computed doubles are rounded to 6 places for comparison with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import complete, contests as ct, models, pairs, prepare, stats
from ..operators.metrics import roc_auc
from ..sources import fixtures as fxt
from ..defaults import GBT_GRID_2
from . import jobs
from .factors import FactorJob
from .tournament import Tournament

SEASONS = list(fxt.TARGET_SEASONS)
NUMOT = list(range(5))       # a contest has 0 to 2, the sum of two medians up to 4


def r6(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 places (comparison hygiene)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _t(spark: SparkSession, sf: str) -> Tournament:
    fx = fxt.Fixtures(fxt.table(spark, sf, "lineitem"), fxt.table(spark, sf, "orders"), SEASONS)
    return Tournament(lambda: fx.contests, lambda: fx.seeds, lambda: fx.targets, SEASONS)


def _stand_in_sub(t: Tournament) -> DataFrame:
    """Targets with ``Pred1`` = Score_Pct of the observed / test rows."""
    scored = t.union.withColumn("Pred1", F.col("Score_Pct"))
    return t.stage(complete.attach_predictions(t.parsed_targets, scored.where(~F.col("is_train")),
                                               scored.where("is_train")))


# ---- sources -----------------------------------------------------------

def _one(spark: SparkSession, sf: str) -> fxt.Fixtures:
    return fxt.one(fxt.table(spark, sf, "lineitem"), fxt.table(spark, sf, "orders"), SEASONS)


def q_scan_contests(spark, sf):
    return r6(_one(spark, sf).contests)


def q_scan_seeds(spark, sf):
    return _one(spark, sf).seeds


def q_scan_targets(spark, sf):
    return _one(spark, sf).targets


def q_submission(spark, sf):
    t = _t(spark, sf)
    return r6(complete.submission(complete.fallback_prediction(_stand_in_sub(t))))


# ---- scalar functions / projections -------------------------------------

def q_parse_seed(spark, sf):
    return ct.parse_seeds(_one(spark, sf).seeds)


def q_parse_target_id(spark, sf):
    return pairs.parse_targets(_one(spark, sf).targets)


def q_seed_join(spark, sf):
    return r6(_t(spark, sf).enriched)


def q_seed_diff(spark, sf):
    return _t(spark, sf).enriched.select("Season", "WTeamID", "LTeamID", "WSeed", "LSeed", "DiffSeed")


def q_mirror_contests(spark, sf):
    return r6(_t(spark, sf).train)


def q_score_features(spark, sf):
    return r6(_t(spark, sf).train.select("Season", "TeamID1", "TeamID2", "Score_Ratio", "Score_Total", "Score_Pct"))


def q_season_filter(spark, sf):
    # the contests are filtered before the seed joins and the mirror
    return r6(_t(spark, sf).season_rows.select("Season", "TeamID1", "TeamID2", "Result", "Score_Pct"))


def q_mirror_pairs(spark, sf):
    return ct.mirror_pairs(fxt.season_contests(spark, sf))


def q_preview_topn(spark, sf):
    mp = ct.mirror_pairs(fxt.season_contests(spark, sf))
    return mp.orderBy("team1", "team2", "pred").limit(5)


# ---- joins -------------------------------------------------------------

def q_observed_pairs(spark, sf):
    t = _t(spark, sf)
    return r6(t.observed.select("Season", "TeamID1", "TeamID2", "NumOT", "Result", "Score_Ratio", "Score_Pct"))


def q_missing_pairs(spark, sf):
    return _t(spark, sf).missing


def q_pair_features(spark, sf):
    return r6(_t(spark, sf).test)


def q_attach_predictions(spark, sf):
    return r6(_stand_in_sub(_t(spark, sf)))


def q_fallback_prediction(spark, sf):
    return r6(complete.fallback_prediction(_stand_in_sub(_t(spark, sf))))


def q_team_index(spark, sf):
    return prepare.team_index(ct.mirror_pairs(fxt.season_contests(spark, sf)))


# ---- aggregations --------------------------------------------------------

def q_team_medians(spark, sf):
    return r6(_t(spark, sf).medians)


def q_harmonic_team_prob(spark, sf):
    p1, p2 = complete.team_probabilities(_stand_in_sub(_t(spark, sf)))
    return r6(p1.select(F.lit(1).alias("side"), F.col("TeamID1").alias("TeamID"), F.col("prob1").alias("prob"))
              .unionByName(p2.select(F.lit(2).alias("side"), F.col("TeamID2").alias("TeamID"),
                                     F.col("prob2").alias("prob"))))


def _encoded(t: Tournament):
    return t.encoded(season_cats=SEASONS, numot_cats=NUMOT)


def q_minmax_stats(spark, sf):
    t = _t(spark, sf)
    enc, cols = _encoded(t)
    return r6(stats.column_min_max(enc.where("is_train"), cols))


def q_distinct_seasons(spark, sf):
    return pairs.parse_targets(_one(spark, sf).targets).select("Season").distinct()


def q_team_cardinality(spark, sf):
    mp = ct.mirror_pairs(fxt.season_contests(spark, sf))
    return mp.agg(F.countDistinct("team1").alias("n_teams"))


def q_null_profile(spark, sf):
    return stats.null_profile(_stand_in_sub(_t(spark, sf)))


# ---- feature preparation -------------------------------------------------

def q_feature_union(spark, sf):
    return r6(_t(spark, sf).union)


def q_one_hot_season(spark, sf):
    enc, _ = _encoded(_t(spark, sf))
    return r6(enc)


def q_minmax_scale(spark, sf):
    t = _t(spark, sf)
    enc, cols = _encoded(t)
    mm = prepare.fit_min_max(enc, cols, eps_train=t.eps_train, eps_test=t.eps_test)
    return r6(mm.transform(enc))


def q_holdout_split(spark, sf):
    t = _t(spark, sf)
    return prepare.holdout_split(t.train.select("Season", "TeamID1", "TeamID2", "Result"))


def q_roc_auc(spark, sf):
    """AUC of the team-1 seed strength (unseeded = 17) per season, over the
    mirrored training rows: many tied scores, so ties are exercised."""
    t = _t(spark, sf)
    s = ct.parse_seeds(t.seeds).select("Season", F.col("TeamID").alias("TeamID1"), "seed_int")
    rows = t.train.join(s, ["Season", "TeamID1"], "left") \
        .withColumn("strength", (F.lit(17) - F.coalesce(F.col("seed_int"), F.lit(17))).cast("double"))
    return r6(roc_auc(rows, "Result", "strength", by=["Season"]))


# ---- models -------------------------------------------------------------
# The original searches: all points, all folds, all trees.


def q_feature_vector(spark, sf):
    v = _t(spark, sf).featured
    return v.select("Season", "TeamID1", "TeamID2", "is_train", F.round("label", 6).alias("label"),
                    F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


def _predictions(spark, sf, family, **kw):
    return r6(jobs.tournament_predictions(_t(spark, sf), family, **kw)[0])


def q_lr_predict(spark, sf):
    return _predictions(spark, sf, "lr")


def q_lr_cv_predict(spark, sf):
    return _predictions(spark, sf, "lr_cv")


def q_gbt_predict(spark, sf):
    return _predictions(spark, sf, "gbt")


def q_gbt_grid_predict(spark, sf):
    """All 12 points and 10 folds of the first grid."""
    return _predictions(spark, sf, "gbt_grid", grid=models.GBT_GRID_1)


def q_gbt_grid2_predict(spark, sf):
    """All 9 points and 10 folds of the second grid."""
    return _predictions(spark, sf, "gbt_grid", grid=GBT_GRID_2)


def q_gbt_subsample_predict(spark, sf):
    """All 12 points and 20 folds."""
    return _predictions(spark, sf, "gbt_subsample")


def q_svc_predict(spark, sf):
    return _predictions(spark, sf, "svc")


def q_grid_report(spark, sf):
    """The search of q_gbt_grid_predict, without completing a table."""
    return r6(models.grid_report(jobs.fit_model(_t(spark, sf), "gbt_grid", grid=models.GBT_GRID_1)))


def _leaves(spark, sf):
    d = _t(spark, sf).featured
    d = d.where(F.col("features").isNotNull())
    return models.fit_gbt(d.where("is_train")), d


def q_gbt_leaf_encode(spark, sf):
    """Leaf ids of the 40 trees and the slots set in their one-hot encoding."""
    model, d = _leaves(spark, sf)
    return model.encode(d).select("Season", "TeamID1", "TeamID2", "is_train", "leaf_ids", "set_slots")


def q_gbt_leaf_lr(spark, sf):
    return r6(jobs.leaf_stack_report(_t(spark, sf)))


def q_gbt_leaf_predict(spark, sf):
    return r6(jobs.leaf_stack_predictions(_t(spark, sf))[0])


def _factor_job(spark, sf):
    fx = fxt.Fixtures(fxt.table(spark, sf, "lineitem"), fxt.table(spark, sf, "orders"), SEASONS)
    return FactorJob(fx.contests.select("WTeamID", "LTeamID")), fx.targets


def q_factor_predict(spark, sf):
    job, targets = _factor_job(spark, sf)
    return r6(job.predict(targets))


def q_loss_history(spark, sf):
    job, _ = _factor_job(spark, sf)
    return r6(job.loss_history())


# ---- checks of fitted models against SQL ---------------------------------

def q_lr_optimal(spark, sf):
    """Per feature: is the gradient of the regularised log loss at the fitted
    coefficients zero (1e-4)?  The loss is convex, so that proves the fit."""
    t = _t(spark, sf)
    m = jobs.fit_model(t, "lr")
    return _gradient_check(t, m, models.LR_C)


def q_lr_cv_optimal(spark, sf):
    """The same for the refit of the cross-validated search, at its best C."""
    t = _t(spark, sf)
    search = jobs.fit_model(t, "lr_cv")
    return _gradient_check(t, search.model, search.points[search.best]["C"])


def _gradient_check(t: Tournament, model, c: float) -> DataFrame:
    train = t.featured.where("is_train")
    w = [float(x) for x in model.coefficients]
    n = train.count()
    p = models.class1_probability(model.transform(train))
    x = vector_to_array("features")
    g = (p.select(F.posexplode(F.transform(F.concat(x, F.array(F.lit(1.0))), lambda v: v * (F.col("Pred1") - F.col("label")))))
         .groupBy("pos").agg((F.sum("col") / n).alias("g")))
    pull = F.get(F.array(*[F.lit(v) for v in [*w, 0.0]]), F.col("pos")) / (c * n)
    return g.select(F.col("pos").cast("int").alias("feature"), (F.abs(F.col("g") + pull) < 1e-4).alias("optimal"))


def q_leaf_slots(spark, sf):
    """Rows by the number of one-hot leaf slots set, and whether rows with
    equal features share all leaves."""
    model, d = _leaves(spark, sf)
    d = model.leaf_vectors(d)
    d = d.withColumn("n_set", F.aggregate(vector_to_array("leaves"), F.lit(0.0), lambda a, v: a + v).cast("int"))
    alike = d.groupBy("features", "n_set").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("leaves").alias("k"))
    return alike.groupBy("n_set").agg(F.sum("rows").alias("rows"), (F.max("k") == 1).alias("leaves_shared"))


def _completeness(family, **kw):
    def query(spark, sf):
        """(ID, multiplicity, scored) of a job's rows, ``scored`` telling the
        model's values from the fallback's."""
        t = _t(spark, sf)
        fitted = jobs.fit_model(t, family, **kw)
        done = t.complete(jobs.score_union(t.featured, fitted, jobs.FITTERS[family][1]))
        inside = F.col("Pred").between(0.0, 1.0)
        return done.groupBy("ID").agg(F.count(F.lit(1)).alias("multiplicity"), F.count("Pred1").alias("scored"),
                                      F.min(inside).alias("in_range"))
    return query


def q_factor_complete(spark, sf):
    """(ID, known): every request once, scored if both teams have played."""
    job, targets = _factor_job(spark, sf)
    return job.predict(targets).select("ID", F.col("pred").isNotNull().alias("known"))


def q_loss_falls(spark, sf):
    """The loss history, one number per epoch, starts at its largest value
    and ends lower."""
    h = q_loss_history(spark, sf)
    return h.agg((F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("falls"),
                 (F.min_by("loss", "epoch") == F.max("loss")).alias("starts_most"),
                 (F.count(F.lit(1)) > 5).alias("by_epoch"))


# ---- earlier seasons, sketches, folds ------------------------------------

def q_prior_medians(spark, sf):
    """Medians per (side, season, team) over all earlier seasons."""
    return r6(pairs.prior_medians(_t(spark, sf).train, SEASONS))


def q_prior_features(spark, sf):
    """Training rows and requests with the pair features of earlier seasons."""
    return r6(_t(spark, sf).with_features("prior_season").union)


def q_season_auc(spark, sf):
    return r6(jobs.season_auc(_t(spark, sf)))


def _sketch_ranks(spark, sf, sketches, rows):
    """Is the sketch's median of NumOT and Score_Ratio within 2 % of the rows
    (or one row) of the middle rank?"""
    cols = ["NumOT", "Score_Ratio"]
    med = pairs.sketch_medians(sketches).select("side", "Season", "TeamID", *[F.col(c).alias(f"m_{c}") for c in cols])
    j = rows.join(med, ["side", "Season", "TeamID"])
    near = lambda c: ((F.sum((F.col(c) < F.col(f"m_{c}")).cast("long")) <= F.count(c) * 0.52 + 1)
                      & (F.sum((F.col(c) <= F.col(f"m_{c}")).cast("long")) >= F.count(c) * 0.48 - 1))
    return j.groupBy("side", "Season", "TeamID").agg(F.count(F.lit(1)).alias("rows"), *[near(c).alias(f"near_{c}") for c in cols])


def _sides(train):
    return train.select(F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col("Season"), F.col(f"TeamID{i}").alias("TeamID"),
                                                    F.col("NumOT").cast("double").alias("NumOT"), "Score_Ratio") for i in (1, 2)])))


def q_sketch_medians(spark, sf):
    train = _t(spark, sf).train
    return _sketch_ranks(spark, sf, pairs.season_sketches(train), _sides(train))


def q_stratified_folds(spark, sf):
    t = _t(spark, sf)
    return prepare.stratified_folds(t.train.select("Season", "TeamID1", "TeamID2", "Result"), 10, "Result")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_contests": q_scan_contests,
    "scan_seeds": q_scan_seeds,
    "scan_targets": q_scan_targets,
    "submission": q_submission,
    "parse_seed": q_parse_seed,
    "parse_target_id": q_parse_target_id,
    "seed_join": q_seed_join,
    "seed_diff": q_seed_diff,
    "mirror_contests": q_mirror_contests,
    "score_features": q_score_features,
    "season_filter": q_season_filter,
    "mirror_pairs": q_mirror_pairs,
    "preview_topn": q_preview_topn,
    "observed_pairs": q_observed_pairs,
    "missing_pairs": q_missing_pairs,
    "pair_features": q_pair_features,
    "attach_predictions": q_attach_predictions,
    "fallback_prediction": q_fallback_prediction,
    "team_index": q_team_index,
    "team_medians": q_team_medians,
    "harmonic_team_prob": q_harmonic_team_prob,
    "minmax_stats": q_minmax_stats,
    "distinct_seasons": q_distinct_seasons,
    "team_cardinality": q_team_cardinality,
    "null_profile": q_null_profile,
    "feature_union": q_feature_union,
    "one_hot_season": q_one_hot_season,
    "minmax_scale": q_minmax_scale,
    "holdout_split": q_holdout_split,
    "roc_auc": q_roc_auc,
    "feature_vector": q_feature_vector,
    "lr_predict": q_lr_predict,
    "lr_cv_predict": q_lr_cv_predict,
    "gbt_predict": q_gbt_predict,
    "gbt_grid_predict": q_gbt_grid_predict,
    "gbt_subsample_predict": q_gbt_subsample_predict,
    "svc_predict": q_svc_predict,
    "grid_report": q_grid_report,
    "gbt_leaf_encode": q_gbt_leaf_encode,
    "gbt_leaf_lr": q_gbt_leaf_lr,
    "factor_predict": q_factor_predict,
    "loss_history": q_loss_history,
    "gbt_grid2_predict": q_gbt_grid2_predict,
    "gbt_leaf_predict": q_gbt_leaf_predict,
    "lr_optimal": q_lr_optimal,
    "lr_cv_optimal": q_lr_cv_optimal,
    "leaf_slots": q_leaf_slots,
    "lr_complete": _completeness("lr"),
    "gbt_complete": _completeness("gbt"),
    "svc_complete": _completeness("svc"),
    "gbt_grid_complete": _completeness("gbt_grid", grid=models.GBT_GRID_1),
    "gbt_grid2_complete": _completeness("gbt_grid", grid=GBT_GRID_2),
    "gbt_subsample_complete": _completeness("gbt_subsample"),
    "factor_complete": q_factor_complete,
    "loss_falls": q_loss_falls,
    "prior_medians": q_prior_medians,
    "prior_features": q_prior_features,
    "season_auc": q_season_auc,
    "sketch_medians": q_sketch_medians,
    "stratified_folds": q_stratified_folds,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The complete prediction table (ID, Pred) of the logistic-regression
    job: fixtures -> features -> fit -> scores -> harmonic fallback."""
    return q_lr_predict(spark, sf)
