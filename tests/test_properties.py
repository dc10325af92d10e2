"""Property tests of the two-level primitives against pandas, random inputs
including one group holding most rows and random slice counts."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rivalry.operators.metrics import roc_auc
from rivalry.operators.ranking import running_sum
from rivalry.operators.stats import group_medians

rows_st = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]),      # "hot" holds most rows
              st.integers(min_value=-5, max_value=5),
              st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False))),
    min_size=1, max_size=60)

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=rows_st, chunks=st.integers(min_value=1, max_value=9))
def test_running_sum_property(spark, rows, chunks):
    data = [(g, k, i) for i, (g, k, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, k int, id int")
    got = running_sum(df, ["g"], ["k", "id"], "k", out="cum", total="tot", chunks=chunks).toPandas()
    pdf = pd.DataFrame(data, columns=["g", "k", "id"]).sort_values(["g", "k", "id"])
    pdf["cum"] = pdf.groupby("g")["k"].cumsum()
    pdf["tot"] = pdf.groupby("g")["k"].transform("sum")
    m = got.merge(pdf, on=["g", "k", "id"], suffixes=("", "_e"))
    assert len(m) == len(data)
    assert (m.cum == m.cum_e).all() and (m.tot == m.tot_e).all()


@SETTINGS
@given(rows=rows_st, chunks=st.integers(min_value=1, max_value=9))
def test_group_median_property(spark, rows, chunks):
    df = spark.createDataFrame(rows, "g string, k int, x double")
    got = group_medians(df, ["g"], ["k", "x"], chunks=chunks).toPandas().set_index("g")
    exp = pd.DataFrame(rows, columns=["g", "k", "x"]).groupby("g")[["k", "x"]].median()
    assert sorted(got.index) == sorted(exp.index)
    for g in exp.index:
        for c in ["k", "x"]:
            e, v = exp.loc[g, c], got.loc[g, c]
            assert (pd.isna(e) and pd.isna(v)) or v == pytest.approx(e, rel=1e-12, abs=1e-12)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(-3, 3)), min_size=2, max_size=60),
       chunks=st.integers(min_value=1, max_value=7))
def test_auc_property(spark, rows, chunks):
    df = spark.createDataFrame(rows, "y int, s int")
    got = roc_auc(df, "y", "s", chunks=chunks).collect()[0].auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        assert got is None
    else:
        u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
        assert got == pytest.approx(u / (len(pos) * len(neg)), abs=1e-12)


pairs_st = st.lists(st.tuples(st.integers(2000, 2001), st.integers(1, 5), st.integers(1, 5),
                              st.integers(0, 2), st.floats(0.1, 0.9)), min_size=1, max_size=25)


@SETTINGS
@given(train_rows=pairs_st, req=st.lists(st.tuples(st.integers(2000, 2001), st.integers(1, 5), st.integers(1, 5)),
                                         min_size=1, max_size=15))
def test_pair_features_equal_restricted_product(spark, train_rows, req):
    from rivalry.operators.pairs import (missing_pairs, observed_pairs, pair_features, parse_targets,
                                         team_medians)
    from .brute import season_pair_stats
    rows = [(s, a, b, n, 1.0, p / (1 - p), p) for s, a, b, n, p in train_rows if a != b]
    if not rows:
        return
    train = spark.createDataFrame(rows, "Season int, TeamID1 bigint, TeamID2 bigint, NumOT int, Result double, "
                                        "Score_Ratio double, Score_Pct double")
    ids = sorted({f"{s}_{min(a, b)}_{max(a, b)}" for s, a, b in req if a != b} |
                 {f"{s}_{a}_{b}" for s, a, b, *_ in rows if a < b})
    targets = parse_targets(spark.createDataFrame([(i, 0.5) for i in ids], "ID string, Pred double"))
    obs = observed_pairs(train, targets, [2000, 2001])
    med = team_medians(obs, chunks=3)
    mis = missing_pairs(train, targets, [2000, 2001])
    fast = sorted((r.Season, r.TeamID1, r.TeamID2, round(r.Score_Pct, 9), r.NumOT)
                  for r in pair_features(mis, med).collect())
    # brute force: the season product of both sides, restricted to the missing pairs
    prod = season_pair_stats(med).join(mis, ["Season", "TeamID1", "TeamID2"])
    brute = sorted((r.Season, r.TeamID1, r.TeamID2,
                    round((0.5 / r.Score_Pct1 + 0.5 / (1 - r.Score_Pct2)) ** -1, 9),
                    float(round(r.NumOT1 + r.NumOT2)))                      # Python round: half to even
                   for r in prod.collect())
    assert fast == brute


@SETTINGS
@given(req=st.lists(st.tuples(st.integers(1, 4), st.integers(5, 8)), min_size=1, max_size=12, unique=True),
       scored=st.lists(st.tuples(st.integers(1, 4), st.integers(5, 8), st.floats(0, 1)), max_size=20))
def test_attach_equals_left_join(spark, req, scored):
    from rivalry.operators.complete import attach_predictions
    from rivalry.operators.pairs import parse_targets
    targets = parse_targets(spark.createDataFrame([(f"2000_{a}_{b}", 0.5) for a, b in req], "ID string, Pred double"))
    preds = spark.createDataFrame([(2000, a, b, p) for a, b, p in scored],
                                  "Season int, TeamID1 bigint, TeamID2 bigint, Pred1 double")
    empty = preds.limit(0)
    got = sorted(tuple(r) for r in attach_predictions(targets, preds, empty)
                 .select("ID", "Pred1").collect())
    exp = sorted(tuple(r) for r in targets.join(preds, ["Season", "TeamID1", "TeamID2"], "left")
                 .select("ID", "Pred1").collect())
    key = lambda t: (t[0], -1.0 if t[1] is None else t[1])
    assert sorted(got, key=key) == sorted(exp, key=key)
