"""Exact ROC AUC, distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
            chunks: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per ``by`` group (ties count half).

    AUC = sum over positives of (negatives scored lower + half the negatives
    scored equal) / (positives * negatives).  Rows are first counted per
    distinct score (partial aggregation), then the running count of negatives
    comes from the two-level :func:`running_sum`, so neither a big group nor
    the whole table lands in one task.  Output: ``by`` columns and ``auc``
    (NULL when a group has no positive or no negative).
    """
    by = list(by)
    lab = F.col(label).cast("double")
    per_score = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                 .groupBy(*by, score)
                 .agg(F.sum(lab).alias("_pos"), F.sum(F.lit(1.0) - lab).alias("_neg")))
    cum = running_sum(per_score, by, [score], "_neg", out="_cneg", chunks=chunks)
    contrib = F.col("_pos") * (F.col("_cneg") - F.col("_neg") + F.lit(0.5) * F.col("_neg"))
    agg = cum.groupBy(*by).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*by, auc.alias("auc"))
