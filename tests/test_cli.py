"""File-to-file runs of both jobs, on CSV inputs written from the fixtures."""

import os
import tempfile

from rivalry.plans import catalog
from rivalry.plans.cli import run_factors, run_leaf_auc, run_tournament
from rivalry.sources import fixtures as fxt
from tests.conftest import SF_SMALL


def _write(df, path):
    df.coalesce(1).write.option("header", True).csv(path)


def test_tournament_and_factor_jobs_from_csv(spark):
    root = tempfile.mkdtemp(prefix="rivalry-cli-", dir="/tmp")
    li, o = fxt.table(spark, SF_SMALL, "lineitem"), fxt.table(spark, SF_SMALL, "orders")
    paths = {k: os.path.join(root, k) for k in ("seeds", "contests", "targets", "sub", "cf")}
    _write(fxt.seeds_from(li, o), paths["seeds"])
    _write(fxt.contests_from(li, o), paths["contests"])
    _write(fxt.targets_from(li, o), paths["targets"])

    run_tournament(spark, paths["seeds"], paths["contests"], paths["targets"], paths["sub"], "lr",
                   seasons=list(fxt.TARGET_SEASONS))
    sub = spark.read.option("header", True).csv(paths["sub"])
    assert sub.columns == ["ID", "Pred"]
    expected = catalog.q_lr_predict(spark, SF_SMALL)
    assert sub.count() == expected.count()
    got = {}
    for r in sub.collect():
        got.setdefault(r.ID, []).append(float(r.Pred))
    for r in expected.collect():
        assert any(abs(v - r.Pred) < 1e-5 for v in got[r.ID])

    run_factors(spark, paths["contests"], paths["targets"], paths["cf"], epochs=2)
    cf = spark.read.option("header", True).csv(paths["cf"])
    assert cf.columns == ["ID", "pred"]
    assert cf.count() == spark.read.option("header", True).csv(paths["targets"]).count()


def test_grid_report_and_leaf_auc_from_csv(spark):
    from rivalry.plans import cli
    root = tempfile.mkdtemp(prefix="rivalry-cli-", dir="/tmp")
    li, o = fxt.table(spark, SF_SMALL, "lineitem"), fxt.table(spark, SF_SMALL, "orders")
    paths = {k: os.path.join(root, k) for k in ("seeds", "contests", "targets", "sub")}
    _write(fxt.seeds_from(li, o), paths["seeds"])
    _write(fxt.contests_from(li, o), paths["contests"])
    _write(fxt.targets_from(li, o), paths["targets"])
    cli.MODEL_ARGS["tiny_grid"] = ("gbt_grid", {"grid": {"trees": [3], "feature_share": [0.5], "depth": [2, 3]}, "folds": 2})
    try:
        rep = run_tournament(spark, paths["seeds"], paths["contests"], paths["targets"], paths["sub"],
                             "tiny_grid", seasons=list(fxt.TARGET_SEASONS), report=True)
    finally:
        del cli.MODEL_ARGS["tiny_grid"]
    rows = rep.collect()
    assert len(rows) == 2 and sum(r.is_best for r in rows) == 1
    auc = {r.model: r.auc for r in run_leaf_auc(spark, paths["seeds"], paths["contests"], paths["targets"],
                                                 seasons=list(fxt.TARGET_SEASONS)).collect()}
    assert set(auc) == {"gbt", "lr", "leaves_lr", "combined_lr"}


def test_command_line_main(spark):
    import subprocess
    import sys
    root = tempfile.mkdtemp(prefix="rivalry-main-", dir="/tmp")
    li, o = fxt.table(spark, SF_SMALL, "lineitem"), fxt.table(spark, SF_SMALL, "orders")
    for name, df in [("seeds", fxt.seeds_from(li, o)), ("contests", fxt.contests_from(li, o)),
                     ("targets", fxt.targets_from(li, o))]:
        _write(df, os.path.join(root, name))
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cmd = [sys.executable, "-m", "rivalry.plans.cli", "tournament", "--conf",
           f"spark.checkpoint.dir={root}/ckpt", "--seeds", f"{root}/seeds", "--contests", f"{root}/contests",
           "--targets", f"{root}/targets", "--out", f"{root}/sub", "--model", "lr",
           "--seasons", ",".join(str(s) for s in fxt.TARGET_SEASONS)]
    done = subprocess.run(cmd, cwd=repo, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    sub = spark.read.option("header", True).csv(f"{root}/sub")
    assert sub.columns == ["ID", "Pred"]
    assert sub.count() == catalog.q_lr_predict(spark, SF_SMALL).count()
