"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a whole text are embedded; learned filters of 12 bytes slide over
them in steps of 4; their responses are max-pooled over overlapping chunks
(1024 bytes, one every 512) that cover the document; the mean and the maximum
of the chunks' values go through one hidden layer to one probability.  A text
is scored in blocks of bounded size, so its length does not matter.

The network is fitted on at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES``, whole and chosen by a hash of the id, in blocks like those of
the scoring; ids whose crc32 is 0 modulo 5 are held out and never learned
from.  Scoring runs in Spark tasks over Arrow batches.

Cases: a NULL text is scored like an empty one; NULL ids are not held out and
have no label; repeated rows are scored alike; labels that are NULL, other
than 0 or 1, or contradict each other for one id are not learned from;
without any label of both kinds every document scores the share of label 1
(0.5 without labels); an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, pin, unpacked

SAMPLE = 3000            # labelled documents to learn from, at most
SAMPLE_BYTES = 64 << 20  # of their whole texts, about
THRESHOLD = 0.3
HELD_OUT = 5             # every fifth id, by crc32
EPOCHS, STEPS = 12, 400   # passes over the sample, or as many as make these steps

STEP, REACH, HALF = 4, 3, 512     # bytes a step, steps a filter, bytes between chunks
EMBED, FILTERS, HIDDEN = 8, 24, 16
WINDOWS = HALF // STEP
BLOCK = 1 << 19          # bytes that are convolved at once


def init(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return {"emb": f(256, EMBED, scale=0.5), "conv": f(REACH, STEP * EMBED, FILTERS, scale=0.15),
            "bias": np.zeros(FILTERS, np.float32), "w1": f(2 * FILTERS, HIDDEN, scale=0.2),
            "b1": np.zeros(HIDDEN, np.float32), "w2": f(HIDDEN, scale=0.3), "b2": np.zeros(1, np.float32)}


def _padded(text: bytes) -> bytes:
    n = max(1, -(-(len(text) + STEP * (REACH - 1)) // HALF))
    return text.ljust(n * HALF, b"\0")


def _responses(net, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Filter responses at every window of whole half chunks; ``ends`` are the
    last windows of documents, behind which zero bytes are seen."""
    a = net["emb"][data].reshape(-1, STEP * EMBED)
    y = a @ net["conv"][0] + net["bias"]
    pad = np.tile(net["emb"][0], STEP)
    for k in range(1, REACH):
        part, blank = a @ net["conv"][k], pad @ net["conv"][k]
        for j in range(k):                 # the windows that reach over the end
            e = ends - j
            keep = y[e] + blank
            y[e] = keep
        inner = np.ones(len(y), bool)
        for j in range(k):
            inner[ends - j] = False
        inner[len(y) - k:] = False
        at = np.flatnonzero(inner)
        y[at] += part[at + k]
    return y


def _halves(net, data: np.ndarray, ends: np.ndarray, want_at: bool = False):
    """Maximum of every filter in every half chunk (and its window)."""
    y = _responses(net, data, ends).reshape(-1, WINDOWS, FILTERS)
    if not want_at:
        return np.maximum(y.max(axis=1), 0)
    at = y.argmax(axis=1)
    top = np.take_along_axis(y, at[:, None, :], 1)[:, 0]
    return np.maximum(top, 0), at + np.arange(len(y))[:, None] * WINDOWS


def _tops(net, data: np.ndarray, ends: np.ndarray, want_at: bool = False):
    """:func:`_halves` of any amount of data, block after block."""
    tops, ats = [], []
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        more = min(len(data), b + HALF)           # what the last windows reach into
        own = ends[(ends >= a // STEP) & (ends < more // STEP)] - a // STEP
        found = _halves(net, data[a:more], own, want_at)
        top, keep = (found[0] if want_at else found), (b - a) // HALF
        tops.append(top[:keep])
        if want_at:
            ats.append(found[1][:keep] + a // STEP)
    return (np.concatenate(tops), np.concatenate(ats)) if want_at else np.concatenate(tops)


def _chunks(top: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Chunk values: the maximum of neighbouring halves of a document; the
    last half of a longer document belongs to the chunk before it."""
    nxt = np.arange(len(top)) + 1
    last = first + count - 1
    nxt[last] = last
    pick = top[nxt] > top
    return np.where(pick, top[nxt], top), pick, nxt


def _pooled(chunk: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(chunk, first, axis=0) / count[:, None]
    return np.concatenate([np.maximum.reduceat(chunk, first, axis=0), mean], axis=1)


def _head(net, x: np.ndarray):
    h = np.tanh(x @ net["w1"] + net["b1"])
    z = h @ net["w2"] + net["b2"][0]
    return h, 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _lay(texts: list[bytes]):
    parts = [_padded(t) for t in texts]
    count = np.array([len(p) // HALF for p in parts])
    first = np.cumsum(count) - count
    return np.frombuffer(b"".join(parts), np.uint8), first, count


def scores(net, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for every text."""
    if "share" in net:
        return np.full(len(texts), float(net["share"]))
    out = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        data, first, count = _lay(texts[i:j])
        top = _tops(net, data, (first + count) * WINDOWS - 1)
        out.append(_head(net, _pooled(_chunks(top, first, count)[0], first, count))[1])
        i = j
    return np.concatenate(out) if out else np.zeros(0)


def _gradients(net, texts: list[bytes], labels: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of ``of`` texts, the part of these."""
    data, first, count = _lay(texts)
    top, at = _tops(net, data, (first + count) * WINDOWS - 1, True)
    chunk, pick, nxt = _chunks(top, first, count)
    x = _pooled(chunk, first, count)
    h, p = _head(net, x)
    n = len(texts)
    dz = ((p - labels) / (of or n)).astype(np.float32)
    g = {"w2": h.T @ dz, "b2": dz.sum(keepdims=True)}
    dh = np.outer(dz, net["w2"]) * (1 - h * h)
    g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
    dx = dh @ net["w1"].T
    # to the windows that won: the document's maximum and every chunk's share of the mean
    doc = np.repeat(np.arange(n), count)
    dchunk = (dx[:, FILTERS:] / count[:, None])[doc]
    best = chunk == x[doc, :FILTERS]
    dchunk += dx[doc, :FILTERS] * best / np.maximum(np.add.reduceat(best, first, axis=0, dtype=np.int64), 1)[doc]
    window = np.where(pick, at[nxt], at)
    dchunk = np.where(chunk > 0, dchunk, 0).astype(np.float32)
    end = ((first + count) * WINDOWS - 1)[doc]
    pad = np.tile(net["emb"][0], STEP)
    g["bias"], g["conv"], demb = dchunk.sum(axis=0), np.zeros_like(net["conv"]), np.zeros_like(net["emb"], np.float64)
    steps = data.reshape(-1, STEP)
    for k in range(REACH):
        to = window + k
        over = to > end[:, None]
        to = np.where(over, 0, to)
        dbytes = []
        for f in range(FILTERS):
            seen = net["emb"][steps[to[:, f]]].reshape(len(to), -1)        # the windows that won, no others
            rows = np.where(over[:, f, None], pad, seen)
            g["conv"][k][:, f] = rows.T @ dchunk[:, f]
            dbytes.append(np.outer(dchunk[:, f], net["conv"][k][:, f]))
        symbols = np.where(over[:, :, None], 0, steps[to]).transpose(1, 0, 2).reshape(-1)      # filter, chunk, byte
        values = np.stack(dbytes).reshape(-1, EMBED)
        for e in range(EMBED):
            demb[:, e] += np.bincount(symbols, values[:, e], 256)
    g["emb"] = demb.astype(np.float32)
    return g


def _batch_gradients(net, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a batch, added up over parts of ``BLOCK`` bytes (one text
    at least)."""
    total: dict[str, np.ndarray] = {}
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        for k, d in _gradients(net, texts[i:j], labels[i:j], len(texts)).items():
            total[k] = total[k] + d if k in total else d
        i = j
    return total


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, batch: int = 48, rate: float = 4e-3,
        seed: int = 11) -> dict[str, np.ndarray]:
    """Fit by Adam on the log loss."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return {"share": np.array(labels.mean() if len(labels) else 0.5)}
    net, r = init(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(x) for k, x in net.items()}
    per_epoch = -(-len(texts) // batch)
    epochs = epochs or max(EPOCHS, -(-STEPS // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            part = order[i:i + batch]
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.95 * step / steps)
            for k, d in _batch_gradients(net, [texts[j] for j in part], labels[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                net[k] = (net[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
                          ).astype(np.float32)
    return net


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Fit on at most ``sample`` labelled documents that are not held out, in
    the order of a hash until they hold ``sample_bytes``."""
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
             .groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_least"), F.max(label).alias("_label"))
             .where("_least = _label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_key", "_label")
    # bounded by the sample, so the broadcast is too; the rows by number and bytes
    rows = pin(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
            .join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")))
    sizes = rows.select("_key", F.octet_length("_text").alias("n"), F.xxhash64("_key").alias("h")).collect()
    held, taken = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["_key"])):
        if held < sample_bytes:
            taken.append(r["_key"])
        held += r["n"]
    some = rows if len(taken) == len(sizes) else rows.where(F.col("_key").isin(taken))
    kept = sorted((r["_key"], bytes(r["_text"]), r["_label"]) for r in some.toLocalIterator())
    return fit([t for _, t, _ in kept], np.array([y for _, _, y in kept], np.float64))


def score(docs: DataFrame, net: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``."""
    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(scores(net, [t.encode("utf-8", "surrogatepass") if t else b"" for t in s]))

    d = packed(docs, score=probability(F.col(text)))
    return unpacked(d, docs.columns, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, net: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The documents the classifier accepts, with their own columns only."""
    d = packed(docs, _text=F.col(text))
    return unpacked(score(d, net, "_text").where("predicted = 1"), docs.columns)
