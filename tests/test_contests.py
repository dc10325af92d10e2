from pyspark.sql import functions as F

from rivalry.operators.contests import mirror_contests, mirror_pairs, seed_join
from rivalry.operators.pairs import parse_targets

CONTESTS = "Season int, WTeamID bigint, WScore double, LTeamID bigint, LScore double, WLoc string, NumOT int"
SEEDS = "Season int, TeamID bigint, Seed string"


def test_seed_join_keeps_unseeded_winner_drops_unseeded_loser(spark):
    c = spark.createDataFrame([(2000, 1, 80.0, 2, 70.0, "N", 0),      # both seeded
                               (2000, 3, 60.0, 1, 50.0, "N", 1),      # winner 3 unseeded
                               (2000, 1, 90.0, 4, 40.0, "N", 0)],     # loser 4 unseeded
                              CONTESTS)
    s = spark.createDataFrame([(2000, 1, "W01"), (2000, 2, "X16a")], SEEDS)
    out = {(r.WTeamID, r.LTeamID): r for r in seed_join(c, s).collect()}
    assert set(out) == {(1, 2), (3, 1)}
    assert out[(1, 2)].WSeed == 1 and out[(1, 2)].LSeed == 16 and out[(1, 2)].DiffSeed == 1
    assert out[(3, 1)].WSeed is None and out[(3, 1)].DiffSeed == 1


def test_equal_seeds_give_zero_diff(spark):
    c = spark.createDataFrame([(2000, 1, 80.0, 2, 70.0, "N", 0)], CONTESTS)
    s = spark.createDataFrame([(2000, 1, "W05"), (2000, 2, "Y05")], SEEDS)
    assert seed_join(c, s).collect()[0].DiffSeed == 0


def test_mirror_doubles_rows_and_balances_labels(spark):
    c = spark.createDataFrame([(2000, 1, 80.0, 2, 20.0, "N", 0, 1), (2001, 3, 60.0, 4, 0.0, "N", 2, 0)],
                              CONTESTS + ", DiffSeed int")
    m = mirror_contests(c)
    rows = {(r.TeamID1, r.TeamID2): r for r in m.collect()}
    assert len(rows) == 4
    assert m.agg(F.avg("Result")).collect()[0][0] == 0.5
    w = rows[(1, 2)]
    assert (w.Result, w.Team1_Score, w.Team2_Score, w.Score_Ratio, w.Score_Total, w.Score_Pct) == \
        (1.0, 80.0, 20.0, 4.0, 100.0, 0.8)
    lo = rows[(2, 1)]
    assert (lo.Result, lo.Score_Ratio, lo.Score_Pct) == (0.0, 0.25, 0.2)
    assert rows[(3, 4)].Score_Ratio is None          # zero denominator -> NULL, not an error


def test_mirror_pairs(spark):
    sc = spark.createDataFrame([(1, 2), (3, 1)], "WTeamID bigint, LTeamID bigint")
    got = sorted(tuple(r) for r in mirror_pairs(sc).collect())
    assert got == [(1, 2, 1), (1, 3, 0), (2, 1, 0), (3, 1, 1)]


def test_parse_ids(spark):
    t = spark.createDataFrame([("2014_1107_1112", 0.5)], "ID string, Pred double")
    r = parse_targets(t).collect()[0]
    assert (r.Season, r.TeamID1, r.TeamID2) == (2014, 1107, 1112)
    from rivalry.operators.contests import parse_seeds
    s = spark.createDataFrame([(2014, 1, "W01"), (2014, 2, "Z16b")], SEEDS)
    assert [r.seed_int for r in parse_seeds(s).orderBy("TeamID").collect()] == [1, 16]
