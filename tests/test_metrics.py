import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from rivalry.operators.metrics import roc_auc


def _brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    u = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_matches_pairwise_definition_with_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = roc_auc(df, "y", "s", chunks=5).collect()[0].auc
    assert got == pytest.approx(_brute(rows), abs=1e-12)
    flipped = spark.createDataFrame([(y, -s) for y, s in rows], "y int, s double")
    assert got + roc_auc(flipped, "y", "s").collect()[0].auc == pytest.approx(1.0, abs=1e-12)


def test_auc_per_group_and_evaluator(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.randint(0, 1), rnd.random()) for g in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = {r.g: r.auc for r in roc_auc(df, "y", "s", by=["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(_brute([(y, s) for gg, y, s in rows if gg == g]), abs=1e-12)
    vec = spark.createDataFrame([(float(y), Vectors.dense([1 - s, s])) for _, y, s in rows], ["label", "raw"])
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0).evaluate(vec)
    allrows = [(y, s) for _, y, s in rows]
    assert ev == pytest.approx(_brute(allrows), abs=1e-9)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert roc_auc(df, "y", "s").collect()[0].auc is None
