"""Fixture derivation on hand-made lineitem / orders rows."""

import datetime as dt

from rivalry.sources.fixtures import Fixtures, contests_from, seeds_from, targets_from

LI = "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double"
ORD = "o_orderkey bigint, o_orderdate timestamp_ntz"


def _tables(spark):
    li = spark.createDataFrame([
        (1, 10, 5.0, 100.0), (1, 10, 7.0, 50.0), (1, 20, 3.0, 90.0), (1, 30, 1.0, 80.0),   # 10 > 20 > 30
        (2, 20, 2.0, 70.0), (2, 30, 4.0, 70.0),                                             # tie: no contest
        (3, 40, 1.0, 60.0),                                                                 # one supplier
        (4, 10, 2.0, 10.0), (4, 20, 2.0, 20.0),                                             # other season
    ], LI)
    orders = spark.createDataFrame([(1, dt.datetime(1999, 3, 1)), (2, dt.datetime(1999, 5, 1)),
                                    (3, dt.datetime(1999, 7, 1)), (4, dt.datetime(1996, 1, 1))], ORD)
    return li, orders


def test_contests_requests_seeds(spark):
    li, o = _tables(spark)
    fx = Fixtures(li, o, seasons=[1999])
    c = sorted(tuple(r) for r in fx.contests.collect())
    # best line per supplier; NumOT = (7 + 3) % 3 = 1 and (2 + 2) % 3 = 1
    assert c == [(1996, 20, 20.0, 10, 10.0, "N", 1), (1999, 10, 100.0, 20, 90.0, "N", 1)]
    t = sorted(r.ID for r in fx.targets.collect())
    # 1999 only; order 1 pairs place 1 with 2 and 2 with 3, the tied order 2 its one pair
    assert t == ["1999_10_20", "1999_20_30"]
    seeds = {(r.Season, r.TeamID): r.Seed for r in fx.seeds.collect()}
    # 1999 revenue (cents): 10 -> 15000, 20 -> 16000, 30 -> 15000, 40 -> 6000; n = 4, 2 seeded (rank*100 <= 272)
    assert seeds[(1999, 20)] == "W01" and seeds[(1999, 10)] == "X01"
    assert (1999, 30) not in seeds and (1999, 40) not in seeds
    # 1996: two teams, one seeded
    assert seeds == {(1999, 20): "W01", (1999, 10): "X01", (1996, 20): "W01"}


def test_one_pass_equals_stand_alone_builders(spark):
    li, o = _tables(spark)
    fx = Fixtures(li, o, seasons=[1999])
    for a, b in [(fx.contests, contests_from(li, o)), (fx.targets, targets_from(li, o, [1999])),
                 (fx.seeds, seeds_from(li, o))]:
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_large_orders_take_the_other_way_to_the_same_rows(spark, monkeypatch):
    from rivalry.sources import fixtures
    li, o = _tables(spark)
    li = li.unionByName(spark.createDataFrame([(5, 10, 1.0, 9.0), (5, 20, 1.0, 8.0), (5, 30, 1.0, 7.0), (None, 10, 1.0, 6.0)], LI))
    o = o.unionByName(spark.createDataFrame([(5, dt.datetime(1999, 1, 1)), (5, dt.datetime(1996, 1, 1))], ORD))

    def rows():
        fx = Fixtures(li, o, seasons=[1999])
        alone = targets_from(li, o, [1999])
        return fx.large, [sorted(map(tuple, d.collect())) for d in (fx.contests, fx.targets, fx.seeds, alone)]
    none, gathered = rows()
    monkeypatch.setattr(fixtures, "LARGE_BUCKET", 2)
    some, ranked = rows()
    monkeypatch.setattr(fixtures, "LARGE_BUCKET", 0)
    every, all_ranked = rows()
    assert not none and 0 < len(some) < len(every)
    assert gathered == ranked == all_ranked
    # order 5 has two seasons: its places are those of the rows asked for
    assert gathered[1] == gathered[3] and ("1999_10_30", 0.5) not in gathered[1]


def test_places_shuffle_lineitem_once(spark):
    from rivalry.sources.fixtures import _places
    li, o = _tables(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fx = Fixtures(li, o, seasons=[1999])
        plan = _places(fx._order_team(li.repartition(3, "l_orderkey")), [1999])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(l_orderkey#" in plan
