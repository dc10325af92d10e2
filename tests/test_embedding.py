"""The block-rotated factor model against numpy, replays and a planted table."""

import math
import random

import numpy as np
import pytest

from rivalry.operators import embedding as E

S = E.Settings(factors=3, l2=1e-3, rate=0.02, batch=16, seed=7)


def start(members=(6, 5)):
    one, two, outer = E.start_block(0, 0, members[0], S), E.start_block(1, 0, members[1], S), E.start_outer(S)
    r = np.random.default_rng(1)
    one["f"], two["f"] = r.normal(size=one["f"].shape), r.normal(size=two["f"].shape)
    return one, two, outer


def test_gradients():
    r = np.random.default_rng(2)
    one, two, outer = start()
    a, b, y = r.integers(0, 6, 20), r.integers(0, 5, 20), r.integers(0, 2, 20).astype(float)
    loss, (ua, g1), (ub, g2), g0 = E.loss_and_gradients(one, two, outer, a, b, y, 1e-2)
    # the loss itself, row by row
    z = [outer["w"] * (one["f"][i] @ two["f"][j] + one["b"][i] + two["b"][j]) + outer["c"] for i, j in zip(a, b)]
    plain = -np.mean([math.log(1 / (1 + math.exp(-v))) if t else math.log(1 - 1 / (1 + math.exp(-v))) for v, t in zip(z, y)])
    penalty = 1e-2 * (6 / len(ua) * (one["f"][ua] ** 2).sum() + 5 / len(ub) * (two["f"][ub] ** 2).sum())
    assert abs(loss - plain - penalty) < 1e-9
    for p, at, g in ((one, ua, g1), (two, ub, g2), (outer, None, g0)):
        for k, d in g.items():
            for i in np.ndindex(d.shape):
                full = i if at is None else (at[i[0]], *i[1:])
                old, found = p[k][full], []
                for step in (1e-6, -1e-6):
                    p[k][full] = old + step
                    found.append(E.loss_and_gradients(one, two, outer, a, b, y, 1e-2)[0])
                p[k][full] = old
                assert abs((found[0] - found[1]) / 2e-6 - d[i]) < 1e-6


def planted(n, seed, teams=24):
    rnd = random.Random(5)
    strength = [rnd.gauss(0, 1.5) for _ in range(teams)]
    kind = [rnd.randrange(3) for _ in range(teams)]        # who beats whom beside strength
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rnd.sample(range(teams), 2)
        edge = strength[a] - strength[b] + 1.5 * ((kind[a] - kind[b] + 1) % 3 - 1)
        y = int(rnd.random() < 1 / (1 + math.exp(-edge)))
        out += [(a, b, y), (b, a, 1 - y)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, y int").repartition(3)


def scores(model, spark, rows):
    ask = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, b long, y int")
    return [r.pred for r in model.score(ask, "a", "b").orderBy("i").collect()]


def log_loss(p, rows):
    return -sum(math.log(q if y else 1 - q) for q, (_, _, y) in zip(p, rows)) / len(rows)


def test_epoch_losses_equal_a_replay(spark):
    """One block: the history is what the same steps give in plain numpy."""
    rows = planted(300, 1)
    model = E.fit(frame(spark, rows), 24, S, epochs=7, patience=None)
    one, two, outer = E.start_block(0, 0, 24, S), E.start_block(1, 0, 24, S), E.start_outer(S)
    chunks = [(r["part"], np.frombuffer(bytes(r["data"]), "<i4").reshape(-1, 3)) for r in _strata(spark, rows).collect()]
    for epoch, expected in enumerate(model.history):
        loss = n = 0
        for part, c in sorted(chunks, key=lambda x: x[0]):
            got = E.train_chunk(one, two, outer, c[:, 0], c[:, 1], c[:, 2].astype(float), S, E.chunk_order(S, epoch, 0, part, len(c)))
            loss, n = loss + got[0], n + got[1]
        assert n == len(rows) and abs(loss / n - expected) < 1e-9
    assert model.history[-1] < model.history[0]


def _strata(spark, rows):
    """The chunks as :func:`fit` makes them for one block."""
    from pyspark.sql import functions as F
    d = frame(spark, rows).withColumn("stratum", F.lit(0).cast("long"))
    salt = F.pmod(F.xxhash64("a", "b", "y"), F.lit(8))
    return (d.repartition(F.col("stratum"), salt).sortWithinPartitions("stratum", "a", "b", "y")
            .mapInArrow(E._chunks(1), "i int, j int, part long, data binary"))


@pytest.mark.parametrize("blocks", [1, 3])
def test_lower_held_out_loss_than_squared_error(spark, blocks):
    rows, later = planted(1500, 2), planted(300, 3)
    s = E.Settings(factors=4, l2=1e-4, rate=0.02, batch=64, seed=3)
    model = E.fit(frame(spark, rows), 24, s, epochs=12, patience=None, blocks=blocks)
    assert len(model.history) == 12 and model.history[-1] < model.history[0]
    found = log_loss(scores(model, spark, later), later)
    assert found < math.log(2) - 0.1

    from pyspark.ml.recommendation import ALS
    als = ALS(rank=4, maxIter=8, regParam=0.1, userCol="a", itemCol="b", ratingCol="r", seed=3).fit(
        spark.createDataFrame([(a, b, y - 0.5) for a, b, y in rows], "a int, b int, r double"))
    ask = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(later)], "i int, a int, b int")
    square = {r.i: 1 / (1 + math.exp(-r.prediction * 4)) for r in als.transform(ask).collect()}
    assert found < log_loss([square[i] for i in range(len(later))], later)


def test_unknown_members_and_no_rows(spark):
    model = E.fit(frame(spark, planted(50, 1)), 24, S, epochs=1)
    ask = spark.createDataFrame([(0, 1), (None, 2), (3, None)], "a long, b long")
    assert sorted(r.pred is None for r in model.score(ask, "a", "b").collect()) == [False, True, True]
    empty = E.fit(frame(spark, [(0, 1, 1)]).limit(0), 2, S, epochs=2)
    assert empty.history == [0.0, 0.0] and empty.side(0).count() == 2


def test_patience(spark):
    model = E.fit(frame(spark, planted(50, 1)), 24, S, epochs=50, patience=2, tol=10.0)
    assert len(model.history) == E.LAPS                  # looked at after a job
    model = E.fit(frame(spark, planted(50, 1)), 24, S, epochs=50, patience=2, tol=10.0, blocks=2)
    assert len(model.history) == 3


def test_blocks_follow_memory_and_rows(spark):
    """Every turn is a job: some thousand members with few rows are one block
    (there were three), many rows are cut into more."""
    rows = [(i, 2999 - i, i % 2) for i in range(0, 3000, 7)]
    model = E.fit(frame(spark, rows), 3000, S, epochs=1, patience=None)
    assert model.blocks == 1 and model.side(0).count() == 3000


def test_more_rows_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "STRATUM_ROWS", 100)
    rows = planted(500, 4)
    model = E.fit(frame(spark, rows), 24, S, epochs=2, patience=None)
    assert model.blocks == 4 and len(model.history) == 2          # 1,000 rows: 16 strata of about 100
    assert sorted(r.idx for r in model.side(1).collect()) == list(range(24))


def test_repeated_members_of_a_batch_are_summed():
    a = np.array([3, 1, 3, 3, 0])
    ua, place, by = E._members(a)
    assert ua.tolist() == [0, 1, 3] and ua[place].tolist() == a.tolist()
    d, rows = np.array([1.0, 2, 3, 4, 5]), np.arange(10.0).reshape(5, 2)
    assert np.allclose(E._summed(d, rows, by), [5 * rows[4], 2 * rows[1], rows[0] + 3 * rows[2] + 4 * rows[3]])


def test_a_chunk_is_the_plain_steps():
    """Rows of a chunk in fast steps against loss, gradients and Adam batch by
    batch; member 2 of side 1 has a third of the rows."""
    r = np.random.default_rng(5)
    n = 70                                                  # the last batch is short
    a = np.where(r.random(n) < 0.33, 2, r.integers(0, 9, n)).astype("<i4")
    b, y = r.integers(0, 7, n).astype("<i4"), r.integers(0, 2, n).astype(float)
    fast, plain = ((E.start_block(0, 0, 9, S), E.start_block(1, 0, 7, S), E.start_outer(S)) for _ in range(2))
    for epoch in range(3):
        order, total = E.chunk_order(S, epoch, 0, 0, n), 0.0
        got, rows = E.train_chunk(*fast, a, b, y, S, order)
        for i in range(0, n, S.batch):
            at = order[i:i + S.batch]
            loss, (ua, g1), (ub, g2), g0 = E.loss_and_gradients(*plain, a[at], b[at], y[at], S.l2)
            total += loss * len(at)
            for p, g, own in ((plain[0], g1, ua), (plain[1], g2, ub), (plain[2], g0, ...)):
                E.adam(p, g, S.rate, own)
        assert rows == n and abs(got - total) < 1e-9
        for p, q in zip(fast, plain):
            assert all(np.allclose(p[k], q[k], atol=1e-12) for k in q)


@pytest.mark.parametrize("blocks", [1, 3])
def test_files_give_what_tables_give(spark, monkeypatch, blocks):
    """The turns over files shuffle nothing (there was one shuffle a turn), leave
    the last blocks and no other file, and score by block pairs."""
    import os
    from urllib.parse import urlparse
    rows = planted(300, 6)
    model = E.fit(frame(spark, rows), 24, S, epochs=4, patience=None, blocks=blocks)
    ask = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)] + [(-1, None, 3), (-2, 3, None), (-3, None, None)],
                                "i int, a long, b long")
    found = {r.i: r.pred for r in model.score(ask, "a", "b").collect()}
    assert model.score(ask, "a", "b").columns == ["i", "a", "b", "pred"]
    left = os.listdir(urlparse(model.folder.uri).path)
    assert sorted(x for x in left if not x.endswith(".crc")) == sorted(n for own in model.names for n in own) and len(left) == 2 * blocks
    monkeypatch.setattr(E.Folder, "new", classmethod(lambda cls, spark: None))
    plain = E.fit(frame(spark, rows), 24, S, epochs=4, patience=None, blocks=blocks)
    assert plain.folder is None and np.allclose(plain.history, model.history, atol=1e-12)
    again = {r.i: r.pred for r in plain.score(ask, "a", "b").collect()}
    assert len(found) == 603 and found.keys() == again.keys()
    assert all(found[i] is None and again[i] is None for i in (-1, -2, -3))
    assert all(abs(found[i] - again[i]) < 1e-12 for i in range(600))


def test_blocks_do_not_wait_for_slots():
    assert E._blocks(500, 30_000, 8, True) == 1
    assert E._blocks(60_000, 16_000_000, 8, True) == 8       # twelve blocks made two rounds of every turn
    assert E._blocks(360_000, 98_000_000, 8, True) == 24     # 22 by members
    assert E._blocks(60_000, 16_000_000, 8, False) == 12


def test_no_epoch(spark):
    model = E.fit(frame(spark, planted(20, 1)), 24, S, epochs=0, blocks=2)
    assert model.history == [] and model.side(0).count() == 24
