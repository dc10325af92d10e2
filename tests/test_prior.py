"""Features of earlier seasons, quantile sketches, stratified folds."""

import random
from collections import Counter
from statistics import median

from rivalry.operators import pairs, prepare
from rivalry.plans import catalog, jobs
from tests.conftest import SF_SMALL

SCHEMA = "Season int, TeamID1 long, TeamID2 long, NumOT int, Score_Ratio double, Score_Pct double, Result double"


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.sample(range(8), 2)
        a = 0 if r.random() < 0.4 else a             # one team has more than a third of the rows
        b = b if b != a else 9
        out.append((r.randint(2000, 2004), a, b, r.randint(0, 2), r.uniform(0.5, 2), r.random(), float(r.randint(0, 1))))
    return out


def brute(data, seasons):
    out = {}
    for side in (1, 2):
        for s in seasons:
            for t in {x[side] for x in data}:
                past = [x for x in data if x[0] < s and x[side] == t]
                if past:
                    out[side, s, t] = tuple(round(median(x[c] for x in past), 9) for c in (3, 4, 5))
    return out


def test_prior_medians(spark):
    data, seasons = rows(), [2000, 2002, 2004]
    got = pairs.prior_medians(spark.createDataFrame(data, SCHEMA), seasons).collect()
    found = {(r.side, r.Season, r.TeamID): tuple(round(r[c], 9) for c in pairs.STAT_COLS) for r in got}
    assert len(found) == len(got) and found == brute(data, seasons)
    assert not any(s == 2000 for _, s, _ in found)        # nothing is known before the first season


def test_no_feature_knows_its_own_season(spark):
    """Changing a season's results changes nothing that its rows are told."""
    data = rows()
    other = [(*x[:4], 9.9, 0.9, 1 - x[6]) if x[0] == 2004 else x for x in data]
    a, b = (sorted(map(tuple, pairs.prior_medians(spark.createDataFrame(d, SCHEMA), [2004]).collect())) for d in (data, other))
    assert a == b and a


def test_season_auc(spark):
    got = {r.train_features: r for r in jobs.season_auc(catalog._t(spark, SF_SMALL)).collect()}
    assert set(got) == {"contest", "prior_season"}
    assert got["contest"].auc > 0.9
    assert got["prior_season"].auc is None or got["prior_season"].auc < got["contest"].auc


def rank_error(values, x):
    lo, hi = sum(v < x for v in values), sum(v <= x for v in values)
    mid = len(values) / 2
    return max(0, lo - mid, mid - hi) / len(values)


def test_sketches(spark):
    r = random.Random(2)
    data = [(2000 + i % 3, 0 if r.random() < 0.5 else 1 + i % 3, 7, i % 3, r.random(), r.gauss(0, 1), 1.0) for i in range(12_000)]
    d = spark.createDataFrame(data, SCHEMA)
    sk = pairs.season_sketches(d)
    for sketches, season in ((sk, lambda s, own: s == own), (pairs.prior_sketches(sk), lambda s, own: s < own)):
        got = pairs.sketch_medians(sketches).collect()
        assert got
        for x in got:
            for c, name in ((4, "Score_Ratio"), (5, "Score_Pct")):
                values = [v[c] for v in data if season(v[0], x.Season) and v[x.side] == x.TeamID]
                assert values and rank_error(values, x[name]) <= 0.02
    assert pairs.prior_sketches(sk).where("Season = 2000").count() == 0
    assert max(len(bytes(x.Score_Pct)) for x in sk.collect()) < 10_000       # bounded, with 6000 rows in one


def test_stratified_folds(spark):
    data = rows(300, 3)
    mirrored = data + [(s, b, a, n, 1 / q, 1 - p, 1 - y) for s, a, b, n, q, p, y in data]
    d = spark.createDataFrame(mirrored, SCHEMA).withColumnRenamed("Result", "label")
    got = prepare.stratified_folds(d, 7).collect()
    assert len(got) == len(mirrored)
    key = lambda r: (r.Season, *sorted((r.TeamID1, r.TeamID2)))
    of = {}
    for r in got:
        assert of.setdefault(key(r), r.fold) == r.fold    # a contest is in one fold
    size = Counter(key(r) for r in got)
    for kind in set(size.values()):
        n = Counter(of[k] for k in of if size[k] == kind)
        assert max(n.values()) - min(n.get(f, 0) for f in range(7)) <= 1
    again = prepare.stratified_folds(d.repartition(5), 7).collect()
    assert {(key(r), r.fold) for r in again} == {(key(r), r.fold) for r in got}
