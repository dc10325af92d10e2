"""Command line: run a job on CSV (or parquet) inputs and write the table.

    python -m rivalry.plans.cli tournament --seeds S --contests C --targets T \
        --out OUT [--model lr|lr_cv|gbt|gbt_grid|gbt_grid2|gbt_subsample|svc] [--seasons 2014,2015,2016,2017] \
        [--report] [--conf spark.checkpoint.dir=DIR ...]
    python -m rivalry.plans.cli leaf-auc --seeds S --contests C --targets T [--seasons ...]
    python -m rivalry.plans.cli factors --contests C --targets T --out OUT

Inputs carry a header and are read with the declared schemas; the output is
a CSV directory with ``ID`` and ``Pred`` (``pred`` for the factor job).
``spark.checkpoint.dir`` must name a shared folder (``--conf KEY=VALUE``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..defaults import FACTOR_EPOCHS, FACTORS, GBT_GRID_1, GBT_GRID_2, REQUEST_SEASONS
from ..operators import models
from ..sources import files
from .factors import FactorJob
from .jobs import leaf_stack_report, tournament_predictions
from .tournament import Tournament

MODEL_ARGS = {
    "lr": ("lr", {}),
    "lr_cv": ("lr_cv", {}),
    "gbt": ("gbt", {}),
    "gbt_grid": ("gbt_grid", {"grid": GBT_GRID_1}),
    "gbt_grid2": ("gbt_grid", {"grid": GBT_GRID_2}),
    "gbt_subsample": ("gbt_subsample", {}),
    "svc": ("svc", {}),
}


def _tournament(spark, seeds, contests, targets, seasons, fmt) -> Tournament:
    return Tournament(files.read_contests(spark, contests, fmt), files.read_seeds(spark, seeds, fmt),
                      files.read_targets(spark, targets, fmt), seasons)


def run_tournament(spark: SparkSession, seeds: str, contests: str, targets: str, out: str,
                   model: str = "lr", seasons=REQUEST_SEASONS, fmt: str = "csv", report: bool = False):
    """Write the completed table; with ``report`` and a searched model, also
    return the grid report (one row per grid point, best marked)."""
    family, kw = MODEL_ARGS[model]
    sub, fitted = tournament_predictions(_tournament(spark, seeds, contests, targets, seasons, fmt), family, **kw)
    files.write_submission(sub, out)
    if report and isinstance(fitted, models.SEARCHES):
        return models.grid_report(fitted)
    return None


def run_leaf_auc(spark: SparkSession, seeds: str, contests: str, targets: str,
                 seasons=REQUEST_SEASONS, fmt: str = "csv"):
    """Hold-out AUC of GBT, LR, LR on leaves, LR on leaves + features."""
    return leaf_stack_report(_tournament(spark, seeds, contests, targets, seasons, fmt))


def run_factors(spark: SparkSession, contests: str, targets: str, out: str, fmt: str = "csv", **kw) -> None:
    req = files.read_targets(spark, targets, fmt)
    job = FactorJob(files.read_season_contests(spark, contests, fmt), **kw)
    files.write_submission(job.predict(req), out, pred_col="pred")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="rivalry")
    sub = ap.add_subparsers(dest="job", required=True)
    t = sub.add_parser("tournament")
    t.add_argument("--seeds", required=True)
    t.add_argument("--contests", required=True)
    t.add_argument("--targets", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--model", default="lr", choices=sorted(MODEL_ARGS))
    t.add_argument("--seasons", default=",".join(str(s) for s in REQUEST_SEASONS))
    t.add_argument("--format", default="csv")
    t.add_argument("--report", action="store_true", help="print the grid report of a searched model")
    la = sub.add_parser("leaf-auc")
    for name in ("--seeds", "--contests", "--targets"):
        la.add_argument(name, required=True)
    la.add_argument("--seasons", default=",".join(str(s) for s in REQUEST_SEASONS))
    la.add_argument("--format", default="csv")
    f = sub.add_parser("factors")
    f.add_argument("--contests", required=True)
    f.add_argument("--targets", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--format", default="csv")
    f.add_argument("--factors", type=int, default=FACTORS)
    f.add_argument("--epochs", type=int, default=FACTOR_EPOCHS)
    for p in (t, la, f):
        p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE",
                       help="Spark setting, e.g. spark.checkpoint.dir=<shared folder>")
    a = ap.parse_args(argv)
    from ..session import build_session
    conf = dict(kv.split("=", 1) for kv in a.conf)
    spark = build_session(app=f"rivalry-{a.job}", conf=conf)
    if a.job == "tournament":
        rep = run_tournament(spark, a.seeds, a.contests, a.targets, a.out, a.model,
                             [int(s) for s in a.seasons.split(",")], a.format, a.report)
        if rep is not None:
            rep.show(truncate=False)
    elif a.job == "leaf-auc":
        run_leaf_auc(spark, a.seeds, a.contests, a.targets, [int(s) for s in a.seasons.split(",")],
                     a.format).show(truncate=False)
    else:
        run_factors(spark, a.contests, a.targets, a.out, a.format,
                    n_factors=a.factors, epochs=a.epochs)


if __name__ == "__main__":
    main()
