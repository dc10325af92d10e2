"""Quality classifier and the inverted multi-index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalry.llm import ann, by_value, quality_cnn

from . import data

by_value()


def corpus(n, seed=4):
    """Clean prose (1) and prose spoilt by symbols (0)."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = data.prose(rnd, rnd.randint(20, 200))
        out.append((t if i % 3 else " ".join(w + rnd.choice(("%%%", "$$$", "###")) for w in t.split()), int(i % 3 > 0)))
    return out


def test_gradients():
    net = {k: v.astype(np.float64) for k, v in quality_cnn.init().items()}
    texts = [t.encode() for t, _ in corpus(5)] + [b"", b"x" * 700]
    y = np.array([1, 0, 1, 1, 0, 1, 0], float)

    def loss(n):
        p = quality_cnn.scores(n, texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    g = quality_cnn._gradients(net, texts, y)
    for k, i in (("w1", (3, 2)), ("w2", (1,)), ("b2", (0,)), ("conv", (0, 5, 3)), ("conv", (2, 7, 0)), ("emb", (101, 2)),
                 ("bias", (4,))):
        up, down = ({q: x.copy() for q, x in net.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs(g[k][i] - (loss(up) - loss(down)) / 2e-5) < 1e-6


def plain_score(net, text):
    """The network written out: every window of every chunk, filter by filter."""
    step, reach, half = quality_cnn.STEP, quality_cnn.REACH, quality_cnn.HALF
    n = max(1, -(-(len(text) + step * (reach - 1)) // half))
    body = text.ljust(n * half, b"\0") + b"\0" * (step * reach)
    at = lambda i, f: net["bias"][f] + sum(
        float(net["emb"][body[i + k * step + b]] @ net["conv"][k][b * quality_cnn.EMBED:(b + 1) * quality_cnn.EMBED, f])
        for k in range(reach) for b in range(step))
    halves = np.array([[max(0.0, *(at(h * half + w, f) for w in range(0, half, step))) for f in range(quality_cnn.FILTERS)]
                       for h in range(n)])
    chunks = np.array([np.maximum(halves[i], halves[min(i + 1, n - 1)]) for i in range(n)])
    x = np.concatenate((chunks.max(0), chunks.mean(0)))
    z = float(np.tanh(x @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0])
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_convolution():
    net = quality_cnn.init(3)
    texts = [b"", b"a", "The end, ça!".encode() * 30, bytes(range(256)) * 5]
    assert np.allclose(quality_cnn.scores(net, texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    """Texts over several blocks, batches over several parts."""
    net = {k: v.astype(np.float64) for k, v in quality_cnn.init().items()}
    texts = [t.encode() for t, _ in corpus(6)] + [("ab %d " % 7 * 2000).encode() + b"end", b""]
    y = np.array([1, 0, 1, 1, 0, 1, 0, 1], float)
    whole = quality_cnn._gradients(net, texts, y)
    monkeypatch.setattr(quality_cnn, "BLOCK", 2 * quality_cnn.HALF)
    parts = quality_cnn._batch_gradients(net, texts, y)
    assert all(np.allclose(whole[k], parts[k], atol=1e-6) for k in whole)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, t, "en", "s", 0, *["x"] * len(data.CLASH)) for i, (t, _) in enumerate(corpus(60))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(60))], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, y: seen.append(list(map(len, texts))) or {"share": np.array(0.5)})
    quality_cnn.train(data.table(spark, rows), labels)
    quality_cnn.train(data.table(spark, rows), labels, sample_bytes=3000)
    assert len(seen[1]) < len(seen[0]) and 3000 <= sum(seen[1]) < 3000 + max(seen[0])


def test_long_texts_are_scored_whole(monkeypatch):
    net = quality_cnn.init()
    texts = [("ab c%d " % i * 3000).encode() for i in range(3)] + [b"", b"short"]
    texts[1] += b"%%%% the very end %%%%"
    whole = quality_cnn.scores(net, texts)
    monkeypatch.setattr(quality_cnn, "BLOCK", 4 * quality_cnn.HALF)
    assert np.allclose(whole, quality_cnn.scores(net, texts), atol=1e-6)
    assert not np.isclose(whole[1], quality_cnn.scores(net, [texts[1][:-22]])[0], atol=1e-9)


def test_held_out_accuracy_and_query_columns(spark):
    rows = [(i, t, "en", "s", 0, *["x"] * len(data.CLASH)) for i, (t, _) in enumerate(corpus(240))]
    rows += [(1000, None, *rows[0][2:]), (1001, "", *rows[0][2:]), (None, "the end", *rows[0][2:]), rows[0]]
    d = data.table(spark, rows)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(240))] + [(None, 1), (3, None), (7, 5)],
                                   "doc_id long, quality int")
    net = quality_cnn.train(d, labels)
    out = quality_cnn.score(d, net).withColumn("held_out", quality_cnn.held_out()).collect()
    truth = dict(enumerate(y for _, y in corpus(240)))
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert 25 < len(held) < 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r.doc_id: r["score"] for r in out}
    assert by_id[1000] == by_id[1001] and not next(r for r in out if r.doc_id is None).held_out
    again = quality_cnn.train(d.repartition(3), labels.repartition(2))
    assert all(np.array_equal(net[k], again[k]) for k in net)
    kept = quality_cnn.keep(d, net)
    assert kept.schema == d.schema and kept.where("score <> 'x'").count() == 0


def test_without_labels(spark):
    d = data.table(spark)
    none = quality_cnn.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_cnn.score(d, none).collect()} == {0.5}
    ones = quality_cnn.train(d, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert {r["score"] for r in quality_cnn.score(d, ones).collect()} == {1.0}
    assert quality_cnn.score(data.table(spark, []), ones).count() == 0


def brute(rows, every, k=5):
    v = [(i, np.array(x, np.float64)) for i, x in rows]
    out = []
    for q, a in v:
        if q % every == 0:
            s = sorted((-float(ann.exact_cosines(b[None], a[None])[0]), i) for i, b in v if i != q)
            out += [(q, n + 1, i, -c) for n, (c, i) in enumerate(s[:k])]
    return out


def vectors(n, dim=16, seed=2):
    r = np.random.default_rng(seed)
    c = r.standard_normal((8, dim))
    return [(i, (c[i % 8] + 0.5 * r.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def test_all_cells_give_brute_force(spark):
    rows = vectors(120)
    rows += [(500 + i, rows[0][1]) for i in range(9)]          # copies: ties by id
    odd = [(600, None), (650, [0.0] * 16), (700, [1.0] * 15 + [None]), (750, [float("nan")] * 16), (800, [1.0] * 4),
           (850, [float("inf")] + [1.0] * 15), (None, rows[1][1]), (900, [])]
    d = spark.createDataFrame(rows + odd + [rows[5]], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(d, F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted(brute(rows, 50))


def test_recall(spark):
    rows = vectors(4000, dim=32)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.search(d, F.col("vec_id") % 100 == 0, probe=600).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 100)}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("n", (0, 1, 3))
def test_few_vectors(spark, n):
    d = spark.createDataFrame(vectors(n), "vec_id long, embedding array<float>")
    assert ann.search(d, F.col("vec_id") % 50 == 0).count() == max(0, n - 1)


def test_walk_visits_pairs_in_order_of_the_sum():
    r = np.random.default_rng(0)
    a, b = r.random(6), r.random(6)
    held = r.integers(0, 4, 36)
    order = sorted((i for i in range(36) if held[i]), key=lambda i: a[i // 6] + b[i % 6])
    assert ann.walk(a, b, held, 10**9, 0) == order
    some = ann.walk(a, b, held, 12, 3)
    assert some == order[:len(some)] and held[some].sum() >= 12 and len(some) >= 3


def like_the_table(n, dim=64, seed=9):
    """Mean of a label plus a Gaussian residual, sized as in sf0.1/embeddings."""
    r = np.random.default_rng(seed)
    return (r.standard_normal((10, dim))[np.arange(n) % 10] * 0.07 + r.standard_normal((n, dim))).astype(np.float32)


def recall(spark, n, k=5):
    import pyarrow as pa
    x = like_the_table(n)
    d = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {(r.query_id, r.vec_id) for r in ann.search(d, F.col("vec_id") % 50 == 0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -2
        hit += sum((q, int(i)) in got for i in np.argpartition(-s, k)[:k])
    return hit / (k * len(range(0, n, 50)))


def clustered(n, dim=64, seed=9):
    """Five hundred tight clusters."""
    r = np.random.default_rng(seed)
    return (r.standard_normal((500, dim))[r.integers(0, 500, n)] + 0.25 * r.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("make", (like_the_table, clustered))
def test_recall_of_a_larger_table(spark, monkeypatch, make):
    """Production parameters, through the walk: on clustered vectors it leaves
    most entries out."""
    walked = []
    real = ann.needed
    monkeypatch.setattr(ann, "needed", lambda *a: walked.append(real(*a)) or walked[-1])
    monkeypatch.setitem(globals(), "like_the_table", make)
    assert recall(spark, 20_000) >= 0.9
    assert make is like_the_table or max(ann.PROBE, walked[0]) < 20_000 / 4


def test_needed_probe():
    r = np.random.default_rng(1)
    u, c1, c2 = r.standard_normal((20, 8)), r.standard_normal((5, 4)), r.standard_normal((5, 4))
    held = r.integers(0, 9, 25)
    want = [[int(i)] for i in r.choice(np.flatnonzero(held), 20)]
    for share in (0.5, 0.9, 1.0):
        n = ann.needed(u, want, c1, c2, held, 4, share)
        found = lambda probe: np.mean([w[0] in ann.walk(a, b, held, probe, 0) for w, a, b in zip(
            want, ann._distances(u[:, :4], c1), ann._distances(u[:, 4:], c2))])
        assert found(n) >= share > (found(n - 1) if n > 1 else 0)
