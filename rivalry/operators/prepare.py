"""Feature preparation: train/test union, one-hot, min-max scaling, team
index, hold-out split, feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import EPS_TEST, EPS_TRAIN, HOLDOUT_TEST_PCT
from ..functions import scalar as fx
from ..session import stored
from .pairs import KEYS
from .ranking import dense_index, row_number
from .stats import column_min_max

def feature_union(observed: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows (the observed contests, with ``Result``) stacked on the
    test rows (missing pairs, ``Result`` NULL), flagged by ``is_train``.
    The flag replaces positional slicing."""
    cols = [*KEYS, "NumOT", "Score_Ratio", "Score_Pct"]
    tr = observed.select(*cols, F.col("Result").cast("double").alias("Result"), F.lit(True).alias("is_train"))
    te = test.select(*cols, F.lit(None).cast("double").alias("Result"), F.lit(False).alias("is_train"))
    return tr.unionByName(te).withColumn("NumOT", F.col("NumOT").cast("double"))


def _label(v) -> str:
    f = float(v)
    return str(int(f)) if f.is_integer() else str(f).replace(".", "_").replace("-", "m")


def one_hot(df: DataFrame, col: str, cats: Sequence, drop: bool = True) -> tuple[DataFrame, list[str]]:
    """Indicator columns ``<col>_<value>`` (0.0/1.0) for the given categories,
    in their order; a NULL or any other value gives all zeros.  (Where the
    categories are not known beforehand use :func:`scaled_features`.)"""
    names = [f"{col}_{_label(v)}" for v in cats]
    out = df.select("*", *[F.when(F.col(col) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(n)
                           for v, n in zip(cats, names)])
    return (out.drop(col) if drop else out), names


def encode_features(union: DataFrame, season_cats: Sequence, numot_cats: Sequence) -> tuple[DataFrame, list[str]]:
    """One-hot Season and NumOT as named columns; feature order = NumOT
    indicators, Season indicators, Score_Ratio, Score_Pct."""
    d, s_names = one_hot(union, "Season", season_cats, drop=False)
    d, n_names = one_hot(d, "NumOT", numot_cats, drop=False)
    return d, [*n_names, *s_names, "Score_Ratio", "Score_Pct"]


@dataclass
class MinMaxModel:
    """Per-feature min and max from the training rows."""
    stats: dict[str, tuple[float, float]]
    eps_train: float = EPS_TRAIN
    eps_test: float = EPS_TEST

    def transform(self, df: DataFrame, flag: str = "is_train") -> DataFrame:
        """``(x - min) / (max - min + eps)``; ``eps`` is ``eps_train`` on
        training rows and ``eps_test`` on the others (the original scales the
        two halves with different constants)."""
        eps = F.when(F.col(flag), F.lit(self.eps_train)).otherwise(F.lit(self.eps_test))
        scaled = {c: (F.col(c) - F.lit(mn)) / (F.lit(mx) - F.lit(mn) + eps) for c, (mn, mx) in self.stats.items()}
        return df.withColumns(scaled)


def fit_min_max(df: DataFrame, cols: Sequence[str], flag: str = "is_train",
                eps_train: float = EPS_TRAIN, eps_test: float = EPS_TEST) -> MinMaxModel:
    """One aggregate over the training rows; the result (two numbers per
    feature) is the model, like any fitted scaler."""
    rows = column_min_max(df.where(F.col(flag)), cols).collect()
    return MinMaxModel({r["feature"]: (r["x_min"], r["x_max"]) for r in rows}, eps_train, eps_test)


CATEGORICAL = ("NumOT", "Season")
NUMERIC = ("Score_Ratio", "Score_Pct")


def _category_table(df: DataFrame, col: str, flag: str, eps_train: float, eps_test: float, n_train: int) -> DataFrame:
    """One row per category: its index (ascending value) and the min-max
    scaled value of its indicator where it is set, on training and on other
    rows.  The indicator's minimum over the training rows is 1 only if all of
    them have the category, its maximum is 0 only if none has."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(F.col(flag).cast("long")).alias("_n"))
    low, high = (F.col("_n") == n_train).cast("double"), (F.col("_n") > 0).cast("double")
    scaled = lambda eps: (F.lit(1.0) - low) / (high - low + F.lit(eps))
    return stored(row_number(c, [], [col], out="_idx").select(
        F.col(col).alias("_cat"), (F.col("_idx") - 1).cast("double").alias("_idx"),
        scaled(eps_train).alias("_train"), scaled(eps_test).alias("_test"), (F.col("_n") == n_train).alias("_all")))


def scaled_features(df: DataFrame, flag: str = "is_train", eps_train: float = EPS_TRAIN, eps_test: float = EPS_TEST,
                    categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC,
                    out: str = "features") -> DataFrame:
    """One-hot, min-max scaled features as one sparse vector ``out``, for any
    number of categories (none of their values comes to the driver).

    Same numbers as :func:`encode_features` followed by :class:`MinMaxModel`;
    the one category that every training row has - its indicator is 0 where
    it is set and below 0 elsewhere - gets a column of its own behind the
    indicators.  A row without a numeric feature (NULL or NaN) has a NULL
    vector if it is to be scored, and fails the job if it is to be learned
    from, as the fit itself would.
    """
    from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler
    row = df.agg(F.sum(F.col(flag).cast("long")).alias("n"),
                 *[f(F.when(F.col(flag), F.col(c))).alias(f"{m}_{c}")
                   for c in numeric for m, f in (("mn", F.min), ("mx", F.max))]).first()
    n_train, parts, d = row["n"] or 0, [], df
    for c in categorical:
        cats = _category_table(df, c, flag, eps_train, eps_test, n_train)
        n = cats.count()
        if not n:
            continue
        idx, val, one, vec = f"_i_{c}", f"_v_{c}", f"_o_{c}", f"_f_{c}"
        t = cats.select(F.col("_cat").alias(f"_c_{c}"), F.col("_idx").alias(idx), F.col("_train").alias(f"_a_{c}"),
                        F.col("_test").alias(f"_b_{c}"))
        # the index past the last category (no category) is the one dropLast leaves out
        kind = {"ml_attr": {"type": "nominal", "num_vals": n + 1, "name": idx}}
        d = d.join(t, F.col(c) == F.col(f"_c_{c}"), "left").withColumns({
            val: F.coalesce(F.when(F.col(flag), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")), F.lit(0.0))})
        d = d.withColumn(idx, F.coalesce(idx, F.lit(float(n))).alias(idx, metadata=kind))
        d = OneHotEncoder(inputCol=idx, outputCol=one, dropLast=True).fit(d).transform(d)
        d = Interaction(inputCols=[val, one], outputCol=vec).transform(d)
        parts.append(vec)
        every = cats.where("_all").select("_cat").head()
        if every is not None and n_train:
            low = F.when(F.col(flag), F.lit(-1.0 / eps_train)).otherwise(F.lit(-1.0 / eps_test))
            d = d.withColumn(f"_m_{c}", F.when(F.col(c) == F.lit(every[0]), F.lit(0.0)).otherwise(low))
            parts.append(f"_m_{c}")
    whole = F.lit(True)
    for c in numeric:
        there = F.col(c).isNotNull() & ~F.isnan(F.col(c))
        whole = whole & there
        lo, hi = row[f"mn_{c}"] or 0.0, row[f"mx_{c}"] or 0.0
        eps = F.when(F.col(flag), F.lit(eps_train)).otherwise(F.lit(eps_test))
        value = F.when(there, (F.col(c) - F.lit(lo)) / (F.lit(hi - lo) + eps)).when(
            F.col(flag), F.raise_error(F.lit(f"training row without {c}")).cast("double")).otherwise(F.lit(0.0))
        d = d.withColumn(f"_s_{c}", value)
        parts.append(f"_s_{c}")
    d = VectorAssembler(inputCols=parts, outputCol="_all_features").transform(d.withColumn("_whole", whole))
    keep = [c for c in df.columns if c != out]
    return d.select(*keep, F.when(F.col("_whole"), F.col("_all_features")).alias(out))


def team_index(pairs: DataFrame, team_col: str = "team1", out: str = "team_idx") -> DataFrame:
    """Dense index 0..n-1 of the distinct teams (ascending id).  The original
    numbers teams by first appearance, which has no meaning in a distributed
    table; any bijection serves the factor model equally."""
    return dense_index(pairs, team_col, out=out).withColumnRenamed(team_col, "TeamID")


def holdout_split(df: DataFrame, test_pct: int = HOLDOUT_TEST_PCT, season: str = "Season",
                  t1: str = "TeamID1", t2: str = "TeamID2", out: str = "is_holdout") -> DataFrame:
    """Deterministic hold-out flag from md5 of the orientation-free contest
    key: both mirrored rows of a contest fall on the same side, and the split
    does not depend on partitioning."""
    bucket = fx.split_bucket(fx.pair_key(season, t1, t2), 100)
    return df.withColumn(out, bucket < F.lit(test_pct))


def stratified_folds(df: DataFrame, folds: int, label: str = "label", season: str = "Season", t1: str = "TeamID1",
                     t2: str = "TeamID2", out: str = "fold") -> DataFrame:
    """Folds 0..folds-1 over contests, all rows of a contest in one, equal in
    size and class share: contests alike in their number of rows and of
    positive rows are numbered by the md5 of their key (two-level row number)
    and dealt in turn, so a fold has at most one of each kind more than
    another."""
    keyed = df.withColumn("_contest", fx.pair_key(season, t1, t2))
    kinds = keyed.groupBy("_contest").agg(F.count(F.lit(1)).alias("_rows"),
                                          F.sum((F.col(label) > 0.5).cast("long")).alias("_positive"))
    dealt = row_number(kinds.withColumn("_md5", F.md5("_contest")), ["_rows", "_positive"], ["_md5", "_contest"], out="_nth")
    dealt = dealt.select("_contest", ((F.col("_nth") - 1) % folds).cast("int").alias(out))
    return keyed.drop(out).join(dealt, "_contest").drop("_contest")
