"""Completing the prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..session import stored
from .pairs import KEYS
from .stats import harmonic_mean_by


def attach_predictions(parsed_targets: DataFrame, test_pred: DataFrame, train_pred: DataFrame,
                       pred_col: str = "Pred1") -> DataFrame:
    """Requested pairs with the model value of every matching scored row.

    Scored rows come from the requested pairs (observed or missing), so the
    original outer join is a left join; a pair scored twice (two meetings)
    keeps both rows.  It is written as an inner join (AQE can split a hot
    pair on either side of an inner join, but only the left side of a left
    join, and here the scored side is the one that can be hot) plus the
    requests without any scored row (anti join against the distinct scored
    keys).  Same rows as the left join.
    """
    preds = test_pred.select(*KEYS, pred_col).unionByName(train_pred.select(*KEYS, pred_col))
    cols = [*parsed_targets.columns, pred_col]          # request columns in their order, then the value
    matched = parsed_targets.join(preds, KEYS, "inner").select(*cols)
    unmatched = (parsed_targets.join(preds.select(*KEYS).distinct(), KEYS, "left_anti")
                 .withColumn(pred_col, F.lit(None).cast("double")).select(*cols))
    return matched.unionByName(unmatched)


def team_probabilities(sub: DataFrame, pred_col: str = "Pred1") -> tuple[DataFrame, DataFrame]:
    """Per-team harmonic mean of the prediction on the team-1 side and on the
    team-2 side (0.5 for a team without any prediction)."""
    p1 = harmonic_mean_by(sub, "TeamID1", pred_col, "prob1")
    p2 = harmonic_mean_by(sub, "TeamID2", pred_col, "prob2")
    return p1, p2


def fallback_prediction(sub: DataFrame, pred_col: str = "Pred1", out: str = "Pred") -> DataFrame:
    """``out`` = the model value, else prob1[TeamID1] * (1 - prob2[TeamID2]);
    a NaN is no value.

    The per-team tables have one row per team and are materialized first: the
    joins then have an exchange on both sides, so adaptive execution can
    split a team that holds a third of the requests (straight from the
    aggregates it could not), and broadcasts a table only after measuring it.
    (The product uses 1 - prob2 although prob2 is already a team-1 win
    probability; kept as specified.)
    """
    sub = sub.withColumn(pred_col, F.when(~F.isnan(pred_col), F.col(pred_col)))
    p1, p2 = (stored(p) for p in team_probabilities(sub, pred_col))
    j = sub.join(p1, "TeamID1", "left").join(p2, "TeamID2", "left")
    return j.withColumn(out, F.coalesce(F.col(pred_col), fx.fallback_product("prob1", "prob2")))


def submission(completed: DataFrame, pred_col: str = "Pred") -> DataFrame:
    return completed.select("ID", F.col(pred_col).alias("Pred"))
