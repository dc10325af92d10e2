"""Boosted trees against a row-by-row version, prefixes, sharing, lock-step."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rivalry.operators import boosting as B


def rows(n=400, seed=1):
    """Binned features, label, fold: one strong feature, one alike, weak ones."""
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, 8, n), r.integers(0, 5, n), r.integers(0, 2, n), r.integers(0, 2, n), np.zeros(n, int)], 1)
    y = (x[:, 0] + 2 * x[:, 2] + r.normal(0, 2, n) > 5).astype(int)
    return x, y, r.integers(0, 4, n)


BINS = [8, 5, 2, 2, 1]


def cells_of(x, y, fold):
    cells, at = np.unique(x, axis=0, return_inverse=True)
    key, n = np.unique(np.stack([at.reshape(-1), fold, y], 1), axis=0, return_counts=True)
    return B.Cells(cells, key[:, 0], key[:, 1], key[:, 2].astype(bool), n)


def brute(x, y, recipe, weight=lambda t: None):
    """Boosting row by row: a node is a list of rows, a split is tried by
    looking at every row, children by recursion.  Returns margins after each
    tree.  ``weight(t)``: rows of tree t, None for all."""
    n, width = len(x), len(BINS)
    scale = B.scale_for(n)
    if recipe.second_order:
        margin = np.zeros(n)
    else:
        margin = np.full(n, math.log(y.mean() / (1 - y.mean())))
    out = []
    for t in range(recipe.trees):
        p = 1 / (1 + np.exp(-margin))
        g = np.where(y == 1, np.rint((1 - p) * scale), -np.rint(p * scale)) / scale
        h = np.rint(p * (1 - p) * scale) / scale
        drawn = weight(t)
        inside = np.ones(n, bool) if drawn is None else drawn
        usable = list(range(width))
        if recipe.columns is not None and recipe.columns < width:
            usable = sorted(usable, key=lambda f: int(B._hashed(recipe.seed, 1, t, f)))[:recipe.columns]

        def value(ids):
            gs, hs = g[ids].sum(), h[ids].sum() + recipe.l2
            return recipe.rate * gs / hs if len(ids) and hs > 0 else 0.0

        def split(ids, f, c):
            return ids[x[ids, f] <= c], ids[x[ids, f] > c]

        def gain(a, b):
            if recipe.second_order:
                if min(h[a].sum(), h[b].sum()) < recipe.min_child - 1e-12:
                    return 0.0
                q = lambda i: g[i].sum() ** 2 / (h[i].sum() + recipe.l2)
                return q(a) + q(b) - q(np.concatenate((a, b)))
            return (g[a].mean() - g[b].mean()) ** 2 * len(a) * len(b) / (len(a) + len(b))

        def grow(ids, everyone, heap, level):
            """Adds the leaf's value to the margins of ``everyone`` there."""
            best = (0.0, None, None)
            if level < recipe.depth and len(ids):
                options = usable
                parts = lambda f: [c for c in range(BINS[f] - 1) if all(map(len, split(ids, f, c)))]
                if recipe.per_node is not None and recipe.per_node < width:
                    order = sorted(range(width), key=lambda f: int(B._hashed(recipe.seed, 2, t, heap, f)))
                    options = order[:recipe.per_node]
                    if not any(parts(f) for f in options):
                        options = [f for f in order if parts(f)][:1]
                for f in sorted(options):
                    for c in parts(f):
                        found = gain(*split(ids, f, c))
                        if found > best[0] + 1e-12:
                            best = (found, f, c)
            if best[1] is None:
                margin[everyone] += value(ids)
                return
            for k, (i, e) in enumerate(zip(split(ids, *best[1:]), split(everyone, *best[1:]))):
                grow(i, e, 2 * heap + 1 + k, level + 1)

        grow(np.flatnonzero(inside), np.arange(n), 0, 0)
        out.append(margin.copy())
    return out


FIRST = B.Recipe(12, 3, per_node=2, seed=3)
SECOND = B.Recipe(12, 4, 0.3, columns=3, second_order=True, l2=1.0, min_child=2.0, seed=5)


def margins(found, cells, x, upto):
    first, trees, _ = found
    at = {tuple(c): i for i, c in enumerate(cells.x.tolist())}
    m = np.full(len(cells.x), first)
    for t in trees[:upto]:
        m = m + t.value[t.leaves(cells.x)]
    return m[[at[tuple(r)] for r in x.tolist()]]


@pytest.mark.parametrize("recipe", [FIRST, B.Recipe(8, 2, per_node=1, seed=3), B.Recipe(5, 4, seed=1), SECOND,
                                    B.Recipe(6, 6, 0.3, second_order=True, l2=1.0, min_child=0.0)])
def test_equals_rows_one_by_one(recipe):
    x, y, fold = rows()
    cells = cells_of(x, y, fold)
    found = B.boost(cells, B.Layout(BINS), recipe)
    for k, expected in enumerate(brute(x, y, recipe), 1):
        assert np.abs(margins(found, cells, x, k) - expected).max() < 1e-6


def test_row_draws():
    """A tree sees the drawn rows alone; each cell's draw is a share of it."""
    x, y, fold = rows()
    cells = cells_of(x, y, fold)
    recipe = B.Recipe(6, 3, 0.3, bag=0.8, second_order=True, l2=1.0, min_child=1.0, seed=9)

    def weight(t):
        drawn = np.random.Generator(np.random.Philox(key=[9, t])).binomial(cells.rows, 0.8)
        left = {(c, f, bool(la)): n for c, f, la, n in zip(cells.cell, cells.fold, cells.label, drawn)}
        at = {tuple(c): i for i, c in enumerate(cells.x.tolist())}
        inside = np.zeros(len(x), bool)
        for i, r in enumerate(x.tolist()):
            key = (at[tuple(r)], fold[i], bool(y[i]))
            if left[key]:
                left[key] -= 1
                inside[i] = True
        assert 0.7 < inside.mean() < 0.9
        return inside

    found = B.boost(cells, B.Layout(BINS), recipe)
    expected = brute(x, y, recipe, weight)
    assert np.abs(margins(found, cells, x, 6) - expected[-1]).max() < 1e-6


def test_prefixes_equal_shorter_fits():
    x, y, fold = rows(300)
    cells, layout = cells_of(x, y, fold), B.Layout(BINS)
    long = B.boost(cells, layout, B.Recipe(60, 3, per_node=1, seed=3), 2, (20, 60))
    short = B.boost(cells, layout, B.Recipe(20, 3, per_node=1, seed=3), 2, (20,))
    assert long[2][20] == short[2][20] and 60 in long[2]
    for a, b in zip(long[1], short[1]):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_separable_labels_stop_learning():
    x = np.repeat(np.arange(8), 20)[:, None]
    y = (x[:, 0] > 3).astype(int)
    cells = cells_of(x, y, np.zeros(len(x), int))
    _, trees, _ = B.boost(cells, B.Layout([8]), B.Recipe(1000, 3, 0.5))
    assert len(trees) < 1000                 # all gradients are 0 by then
    one = cells_of(x[:20], y[:20], np.zeros(20, int))
    assert not B.boost(one, B.Layout([8]), B.Recipe(10, 3))[1]


def frame(spark, n=400):
    x, y, fold = rows(n)
    # the first bin of feature 0 is far off, so quantiles are not the bins' numbers
    data = [([float(v) for v in r], float(la), int(f)) for r, la, f in zip(x, y, fold)]
    d = spark.createDataFrame(data, "x array<double>, label double, fold int").repartition(3)
    return d.select(array_to_vector("x").alias("features"), "label", "fold"), (x, y, fold)


def test_cells_and_cuts(spark):
    d, (x, y, fold) = frame(spark)
    cuts = B.feature_cuts(d)
    assert [len(c) + 1 for c in cuts] == BINS and cuts[0] == [i + 0.5 for i in range(7)] and cuts[4] == []
    got = B.Cells.of(B.cell_table(d, cuts).toArrow())
    want = cells_of(x, y, fold)
    for name in ("x", "cell", "fold", "label", "rows"):
        assert (getattr(got, name) == getattr(want, name)).all()
    many = spark.range(1000).select(array_to_vector(F.array((F.col("id") * 1.0))).alias("features"))
    cut, = B.feature_cuts(many, max_bins=16)
    assert len(cut) <= 16 and cut == sorted(cut)


def make(p, width):
    return B.Recipe(p["trees"], p["depth"], per_node=B.share_of(p["share"], width), seed=3)


POINTS = [{"trees": t, "depth": k, "share": s} for t in (5, 12) for k in (2, 3) for s in (0.001, 0.005)]


def test_search_shares_runs(spark):
    d, _ = frame(spark)
    found = B.search(d, POINTS, make)
    assert found.fits == 2 * 4 and len(found.metrics) == 8          # 2 depths x 4 folds serve 8 points
    by = {tuple(p.values()): m for p, m in zip(found.points, found.metrics)}
    assert all(by[t, k, 0.001] == by[t, k, 0.005] for t in (5, 12) for k in (2, 3))
    for p, m in zip(found.points, found.metrics):                   # each point by itself
        assert abs(B.search(d, [p], make).metrics[0] - m) < 1e-12


def test_lock_step_grows_the_same_trees(spark, monkeypatch):
    d, _ = frame(spark)
    points = [{"trees": t, "depth": 2, "share": 0.5} for t in (2, 12)]
    here = B.search(d, points, make)
    second = lambda width: B.Recipe(3, 3, 0.3, second_order=True, l2=1.0, min_child=2.0, seed=5)
    want = B.fit(d, second)
    monkeypatch.setattr(B, "CELL_ROWS", 10)
    there = B.search(d, points, make)
    got = B.fit(d, second)
    assert here.metrics == there.metrics
    for a, b in ((here.model, there.model), (want, got)):
        assert a.first == b.first and len(a.trees) == len(b.trees)
        for s, t in zip(a.trees, b.trees):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value, atol=1e-12)


def test_lock_step_with_row_draws(spark, monkeypatch):
    monkeypatch.setattr(B, "CELL_ROWS", 10)
    d, (x, y, _) = frame(spark)
    bagged = lambda width: B.Recipe(11, 3, 0.3, bag=0.8, second_order=True, l2=1.0, seed=5)
    a, b = B.fit(d, bagged), B.fit(d, bagged)
    assert all((s.value == t.value).all() for s, t in zip(a.trees, b.trees)) and len(a.trees) == 11
    assert ((a.margins(x) > 0) == y).mean() > 0.7


def test_transform_and_leaves(spark):
    d, (x, y, _) = frame(spark)
    m = B.fit(d, lambda width: FIRST)
    got = m.encode(m.transform(d)).select("features", "Pred1", "leaf_ids", "set_slots").collect()
    assert len(got) == len(x)
    slots = m.leaf_slots()
    for r in got:
        row = np.array([r["features"].toArray()]).astype(int)
        assert abs(r["Pred1"] - 1 / (1 + math.exp(-m.margins(row)[0]))) < 1e-12
        at = [int(t.leaves(row)[0]) for t in m.trees]
        assert r["leaf_ids"] == at and r["set_slots"] == [int(s[a]) for s, a in zip(slots, at)]
    v = m.leaf_vectors(d, "leaves", "both").select("features", "leaves", "both").first()
    assert v["leaves"].size == m.slots and len(v["leaves"].indices) == len(m.trees)
    assert v["both"].toArray().tolist() == [*v["leaves"].toArray(), *v["features"].toArray()]
    assert B.Boosted([[]], 0.0, []).encode(d).first()["leaf_ids"] == []


def test_one_label_and_empty(spark):
    d, _ = frame(spark, 50)
    sure = B.fit(d.withColumn("label", F.lit(1.0)), lambda width: FIRST)
    assert sure.transform(d).agg(F.min("Pred1")).first()[0] > 0.999
    none = B.fit(d.limit(0), lambda width: FIRST)
    assert none.transform(d).agg(F.max("Pred1")).first()[0] == 0.5


def test_bins_count_the_cuts_below_and_cells_are_sent_to_the_rows(spark):
    from bisect import bisect_left

    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType
    values = [-math.inf, -1.0, 0.0, 0.5, 0.75, 2.0, math.inf]
    cuts = [[-1.0, 0.0, 0.0, 0.5, 1.0], [], [0.6]]
    df = spark.createDataFrame([(Vectors.dense([a, b, a]),) for a in values for b in (0.0, 1.0)],
                               StructType([StructField("features", VectorUDT())]))
    got = B.with_cells(df, cuts).collect()
    assert [r["_cell"] for r in got] == [[bisect_left(c, float(v)) for c, v in zip(cuts, r.features)] for r in got]
    model = B.Boosted(cuts, 0.25, [])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = model.transform(df)
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert scored.count() == len(got)


def test_cells_take_few_comparisons_and_leaves_are_encoded_once_a_cell(spark):
    """A comparison per cut made a method too large for the JVM to translate;
    the one-hot function ran once a row, above the join with the cells."""
    d, _ = frame(spark, 60)
    cuts = [[i / 64 for i in range(63)], [0.5]]
    wide = spark.createDataFrame([(i, [i / 640, float(i % 2)]) for i in range(-5, 700)], "i int, x array<double>")
    got = B.with_cells(wide.select("i", array_to_vector("x").alias("features")), cuts)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">") < 10
    assert all(r["_cell"] == [sum(c < r.i / 640 for c in cuts[0]), r.i % 2] for r in got.collect())
    v = B.fit(d, lambda width: FIRST).leaf_vectors(d)
    assert "EvalPython" not in v._jdf.queryExecution().executedPlan().toString()


def test_runs_of_a_task_share_their_draws(monkeypatch):
    x, y, fold = rows(300)
    cells, layout = cells_of(x, y, fold), B.Layout(BINS)
    recipe = B.Recipe(6, 3, 0.3, bag=0.8, second_order=True, l2=1.0, min_child=1.0, seed=9)
    runs = [(recipe, 0), (B.replace(recipe, depth=2), 1), (B.replace(recipe, trees=3), 2), (FIRST, 1)]
    alone = [B.boost(cells, layout, *run, (3,)) for run in runs]
    draws, plain = [], B.drawn_rows
    monkeypatch.setattr(B, "drawn_rows", lambda rows, r, number: draws.append(number) or plain(rows, r, number))
    together = B.boost_together(cells, layout, runs, [(3,)] * 4)
    assert draws == list(range(6))                      # every run drew for itself: 15
    for (a, trees, told), (b, again, right) in zip(alone, together):
        assert a == b and told == right and len(trees) == len(again)
        assert all((s.feature == t.feature).all() and (s.value == t.value).all() for s, t in zip(trees, again))


def test_search_with_row_draws_deals_runs_to_tasks(spark):
    d, (x, y, fold) = frame(spark, 200)
    make = lambda p, width: B.Recipe(4, p["depth"], 0.3, bag=0.8, second_order=True, l2=1.0, min_child=p["least"], seed=5)
    points = [{"depth": k, "least": m} for k in (2, 3) for m in (0.5, 1.0, 2.0)]       # 24 runs, 12 tasks
    found = B.search(d, points, make)
    cells, layout = cells_of(x, y, fold), B.Layout(BINS)
    for p, m in zip(found.points, found.metrics):
        right = [B.boost(cells, layout, make(p, 5), f, (4,))[2][4] / (fold == f).sum() for f in range(4)]
        assert abs(m - sum(right) / 4) < 1e-12
