import pytest

from rivalry.operators.complete import attach_predictions, fallback_prediction
from rivalry.operators.pairs import (missing_pairs, observed_pairs, pair_features, parse_targets,
                                     team_medians)
from .brute import season_pair_stats

TRAIN = "Season int, TeamID1 bigint, TeamID2 bigint, NumOT int, Result double, Score_Ratio double, Score_Pct double"


def _train(spark):
    rows = [
        (2000, 1, 2, 0, 1.0, 1.5, 0.6), (2000, 2, 1, 0, 0.0, 0.5, 0.4),
        (2000, 1, 2, 1, 1.0, 1.2, 0.55), (2000, 2, 1, 1, 0.0, 0.8, 0.45),   # repeat meeting 1-2
        (2000, 2, 3, 2, 1.0, 2.0, 0.7), (2000, 3, 2, 2, 0.0, 0.5, 0.3),
        (1999, 1, 3, 1, 1.0, 1.1, 0.52), (1999, 3, 1, 1, 0.0, 0.9, 0.48),   # not a target season
    ]
    return spark.createDataFrame(rows, TRAIN)


def _targets(spark):
    return parse_targets(spark.createDataFrame(
        [("2000_1_2", 0.5), ("2000_2_3", 0.5), ("2000_1_3", 0.5), ("2000_3_4", 0.5)], "ID string, Pred double"))


def test_observed_and_missing_partition_targets(spark):
    tr, tg = _train(spark), _targets(spark)
    obs = observed_pairs(tr, tg, [2000])
    mis = missing_pairs(tr, tg, [2000])
    okeys = {(r.TeamID1, r.TeamID2) for r in obs.collect()}
    mkeys = {(r.TeamID1, r.TeamID2) for r in mis.collect()}
    assert okeys == {(1, 2), (2, 3)} and mkeys == {(1, 3), (3, 4)}
    assert okeys | mkeys == {(r.TeamID1, r.TeamID2) for r in tg.collect()}
    assert obs.where("TeamID1 = 1 AND TeamID2 = 2").count() == 2            # repeat meeting kept twice


def test_pair_features_equal_brute_force_product(spark):
    tr, tg = _train(spark), _targets(spark)
    obs = observed_pairs(tr, tg, [2000])
    med = team_medians(obs, chunks=3)
    mis = missing_pairs(tr, tg, [2000])
    fast = {(r.TeamID1, r.TeamID2): r for r in pair_features(mis, med).collect()}
    brute = season_pair_stats(med).join(mis, ["Season", "TeamID1", "TeamID2"])
    assert set(fast) == {(r.TeamID1, r.TeamID2) for r in brute.collect()} == {(1, 3)}
    r = fast[(1, 3)]
    # team 1 as TeamID1: NumOT median of {0,1} = 0.5; team 3 as TeamID2: {2} -> 2.5 -> rounds to 2
    assert r.NumOT == 2.0
    assert r.Score_Ratio == pytest.approx((1.35 * 2.0 ** -1) ** 0.5)
    assert r.Score_Pct == pytest.approx((0.5 / 0.575 + 0.5 / (1 - 0.7)) ** -1)


@pytest.mark.parametrize("a,b,expected", [(0.0, 0.5, 0.0), (0.5, 1.0, 2.0), (1.0, 1.5, 2.0), (1.5, 2.0, 4.0)])
def test_half_even_rounding(spark, a, b, expected):
    med = spark.createDataFrame([(1, 2000, 1, a, 1.0, 0.5), (2, 2000, 2, b, 1.0, 0.5)],
                                "side int, Season int, TeamID bigint, NumOT double, Score_Ratio double, Score_Pct double")
    mis = spark.createDataFrame([(1, 2, 2000)], "TeamID1 bigint, TeamID2 bigint, Season int")
    assert pair_features(mis, med).collect()[0].NumOT == expected


def test_completion_with_fallback_and_repeats(spark):
    tg = _targets(spark)
    train_pred = spark.createDataFrame([(2000, 1, 2, 0.6), (2000, 1, 2, 0.8), (2000, 2, 3, 0.7)],
                                       "Season int, TeamID1 bigint, TeamID2 bigint, Pred1 double")
    test_pred = spark.createDataFrame([], "Season int, TeamID1 bigint, TeamID2 bigint, Pred1 double")
    sub = attach_predictions(tg, test_pred, train_pred)
    assert sub.count() == 5                                                 # 1-2 twice
    out = fallback_prediction(sub)
    got = {}
    for r in out.collect():
        got.setdefault(r.ID, []).append(r.Pred)
    assert sorted(got["2000_1_2"]) == [0.6, 0.8]
    prob1_t1 = (0.5 * (1 / 0.6 + 1 / 0.8)) ** -1                           # team 1 on the team-1 side
    prob2_t3 = 0.7                                                          # team 3 on the team-2 side
    assert got["2000_1_3"][0] == pytest.approx(prob1_t1 * (1 - prob2_t3))
    # team 3 never has a team-1 prediction -> 0.5; team 4 never on team-2 side with a value -> 0.5
    assert got["2000_3_4"][0] == pytest.approx(0.5 * (1 - 0.5))
