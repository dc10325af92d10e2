"""Latent factors of two sides, learned by log loss in rotating blocks.

The model of a pair (a on side 1, b on side 2) is

    sigmoid(w * (<u_a, v_b> + s_a + t_b) + c)

with factor rows u, v, one bias per member and side (s, t) and one outer weight
and offset.  The loss of a batch is its mean log loss plus an L2 penalty on
the factors (not on the biases): that of all members of its blocks, estimated
from those it holds.  Steps are Adam's, taken by the members of the batch.

Members are cut into blocks.  A stratum is the rows of one block pair; in turn
``s`` block ``i`` of side 1 meets block ``(i + s) mod blocks`` of side 2, so no
two strata of a turn share a member and each is a task of its own.  It reads
its two blocks, streams the rows of its stratum chunk by chunk in batches, and
returns the blocks with their Adam moments beside them.  Blocks and rows stay
in the cluster; on the driver are the losses and the two outer numbers, which
are averaged over a turn's strata by rows.

An epoch passes every row once.  Its loss is gathered while it trains (the
mean over its batches, each before its step), so the history costs no pass.
Training ends after ``epochs``, or when ``patience`` epochs have not lowered
the least loss by more than ``tol``.  Where all members are one block nothing
rotates, so a job makes ``LAPS`` epochs (and patience is looked at after each
job).  A turn is a job, so there are no more blocks than memory and the rows of
a stratum ask for.

With a shared folder (``spark.checkpoint.dir``) blocks and strata are files in
it (:class:`Folder`): a turn is one stage that reads and writes its blocks there
and shuffles nothing, and what the next turn does not need is deleted.  Without
one, blocks and strata are tables that every turn shuffles together.

All random numbers come from the seed and the block, epoch and chunk at hand,
so a retried task repeats its work.
"""

from __future__ import annotations

import math
import pickle
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import checkpoint_dir, configured_dir, materialize

BLOCK_MEMBERS = 16_384   # members of a block, at most about
STRATUM_ROWS = 120_000   # rows of a stratum, about, where turns shuffle and members are alike
CHUNK = 1 << 16          # rows that a task holds at a time
LAPS = 5                 # epochs of one job where there is one block
PAIRS = 8192             # pairs scored at a time
BATCH = 128
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    factors: int = 50
    l2: float = 1e-4
    rate: float = 0.001
    batch: int = BATCH
    seed: int = 42


def start_block(side: int, block: int, members: int, s: Settings) -> dict[str, np.ndarray]:
    """Parameters of a block and their Adam moments (steps taken: 0)."""
    r = np.random.default_rng([s.seed, side, block])
    rows = np.zeros((members, 3, s.factors + 1))
    rows[:, 0, :-1], rows[:, 0, -1] = r.uniform(-0.05, 0.05, (members, s.factors)), r.uniform(-0.05, 0.05, members)
    return _named(np.zeros(1), rows)


def _named(step: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """A block whose members are ``rows``: parameters, first and second moments
    side by side, in each the factors and the bias last.  Also by name."""
    parts = {f"{m}{k}": rows[:, i, at] for i, m in enumerate(("", "m_", "v_")) for k, at in (("f", slice(-1)), ("b", -1))}
    return {"step": step, "rows": rows, **parts}


def _dumped(block: dict[str, np.ndarray]) -> bytes:
    return pickle.dumps((block["step"], block["rows"]))


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    step, rows = pickle.loads(data)
    return _named(step.copy(), rows.copy())      # numpy's own memory is quicker to reach


def start_outer(s: Settings) -> dict[str, np.ndarray]:
    own = {"w": np.array(np.random.default_rng([s.seed, 0, 0]).uniform(-math.sqrt(3), math.sqrt(3))), "c": np.array(0.0)}
    return {"step": np.zeros(1), **own, **{f"{m}_{k}": np.zeros(()) for m in ("m", "v") for k in own}}


def loss_and_gradients(one, two, outer, a: np.ndarray, b: np.ndarray, y: np.ndarray, l2: float):
    """Mean log loss of a batch plus the penalty; the members of either side
    in it; the gradients of their factors and biases, and of (w, c)."""
    (ua, ia, by1), (ub, ib, by2) = _members(a), _members(b)
    pull1, pull2 = l2 * len(one["b"]) / len(ua), l2 * len(two["b"]) / len(ub)
    u, v = one["f"].take(ua, 0), two["f"].take(ub, 0)
    ur, vr = u.take(ia, 0), v.take(ib, 0)
    inner = np.einsum("ij,ij->i", ur, vr) + one["b"][a] + two["b"][b]
    z = outer["w"] * inner + outer["c"]
    e = np.exp(-np.abs(z))
    loss = float((np.maximum(z, 0) - z * y + np.log1p(e)).sum()) / len(y)
    loss += pull1 * float(np.vdot(u, u)) + pull2 * float(np.vdot(v, v))
    dz = (np.where(z >= 0, 1.0, e) / (1 + e) - y) / len(y)
    d = dz * outer["w"]
    g1 = {"f": _summed(d, vr, by1), "b": np.bincount(ia, d, len(ua))}
    g2 = {"f": _summed(d, ur, by2), "b": np.bincount(ib, d, len(ub))}
    for g, pull, own in ((g1, pull1, u), (g2, pull2, v)):
        own *= 2 * pull
        g["f"] += own
    return loss, (ua, g1), (ub, g2), {"w": np.array((dz * inner).sum()), "c": np.array(dz.sum())}


def _members(a: np.ndarray):
    """The members of a batch, every row's place among them, and the rows
    sorted by member with the first row of each."""
    order = a.argsort(kind="stable")
    own = a[order]
    new = np.empty(len(a), bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.empty(len(a), np.intp)
    place[order] = new.cumsum() - 1
    return own[new], place, (order, new.nonzero()[0])


def _summed(d: np.ndarray, rows: np.ndarray, by) -> np.ndarray:
    """Per member the sum of its rows' ``d * rows``."""
    order, first = by
    return np.add.reduceat(rows.take(order, 0) * d[order, None], first, axis=0)


def adam(p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, at=...) -> None:
    """One step of the rows ``at``."""
    p["step"] += 1
    t = p["step"][0]
    step = rate * math.sqrt(1 - BETA2 ** t) / (1 - BETA1 ** t)
    for k, d in g.items():
        m, v, old = (x[at] if at is ... else x.take(at, 0) for x in (p[f"m_{k}"], p[f"v_{k}"], p[k]))
        m, v = BETA1 * m, BETA2 * v
        m += (1 - BETA1) * d
        v += (1 - BETA2) * d * d
        p[f"m_{k}"][at], p[f"v_{k}"][at] = m, v
        p[k][at] = old - step * m / (np.sqrt(v) + TINY)


def _repeats(at: np.ndarray, size: int):
    """Of batches of ``size`` rows with the members ``at``: the members of every
    batch, a mark (1.0) at one row of each, and per batch None or the rows of the
    members that have several, sorted by member, with every member's first among
    them and every row's member."""
    n = len(at)
    batch = np.arange(n) // size
    key = batch * (int(at.max(initial=0)) + 1) + at
    order = key.argsort(kind="stable")
    own = key[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    one = np.zeros(n)
    one[order[new]] = 1.0
    nth = new.cumsum() - 1
    several = np.bincount(nth, minlength=1)[nth] > 1
    rows, starts = order[several], new[several]
    batches = -(-n // size)
    cuts = np.searchsorted(batch[rows], np.arange(batches + 1)).tolist()
    found = [None if x == z else (rows[x:z] - i * size, starts[x:z].nonzero()[0], starts[x:z].cumsum() - 1)
             for i, (x, z) in enumerate(zip(cuts, cuts[1:]))]
    return np.bincount(batch[order[new]], minlength=batches).tolist(), one, found


def _rate(rate: float, t: float) -> float:
    return rate * math.sqrt(1 - BETA2 ** t) / (1 - BETA1 ** t)


def train_chunk(one, two, outer, a, b, y, s: Settings, order: np.ndarray) -> tuple[float, int]:
    """Steps over a chunk in the given order; (sum of batch losses weighted by
    rows, rows).

    The steps are those of :func:`loss_and_gradients` and :func:`adam`.  The
    members of a batch are fetched once, row by row, side 1 above side 2; one
    that has several rows is there as often, each time with its rows' summed
    gradient, so all its copies take the same step."""
    size, width = s.batch, s.factors + 1
    a, b, y = a[order].astype(np.intp), b[order].astype(np.intp), y[order]
    (k1, one1, several1), (k2, one2, several2) = _repeats(a, size), _repeats(b, size)
    rows1, rows2 = (x["rows"].reshape(len(x["rows"]), -1) for x in (one, two))
    item = f"V{rows1.itemsize * 3 * width}"                   # a member's row moved as one thing
    put1, put2 = rows1.view(item)[:, 0], rows2.view(item)[:, 0]
    most = 2 * min(size, max(len(y), 1))
    fetched = np.empty((most, 3, width))
    flat = fetched.reshape(most, -1)
    put = flat.view(item)[:, 0]
    p_, m_, v_, g_, t_ = (np.empty((most, width)) for _ in range(5))
    half, zs, pulled = 0.5 - y, np.empty(len(y)), 0.0
    (w, mw, vw), (c, mc, vc) = ([float(outer[f"{m}{k}"]) for m in ("", "m_", "v_")] for k in "wc")
    t1, t2, t0 = (x["step"][0] for x in (one, two, outer))
    for i, at in enumerate(range(0, len(y), size)):
        ia, ib = a[at:at + size], b[at:at + size]
        n = len(ia)
        p, m, v, g, t, got = (x[:2 * n] for x in (p_, m_, v_, g_, t_, fetched))
        rows1.take(ia, 0, out=flat[:n], mode="clip")
        rows2.take(ib, 0, out=flat[n:2 * n], mode="clip")
        p[:] = got[:, 0]
        u, q = p[:n], p[n:]
        inner = np.einsum("ij,ij->i", u[:, :-1], q[:, :-1])
        inner += u[:, -1]
        inner += q[:, -1]
        z = np.multiply(inner, w, out=zs[at:at + n])
        z += c
        dz = np.tanh(0.5 * z)                                 # sigmoid(z) - y
        dz *= 0.5
        dz += half[at:at + n]
        dz /= n
        d = (dz * w)[:, None]
        np.multiply(q, d, out=g[:n])
        np.multiply(u, d, out=g[n:])
        g[:n, -1:] = g[n:, -1:] = d
        for several, start in ((several1[i], 0), (several2[i], n)):
            if several is not None:
                rows, first, nth = several
                rows = rows + start
                g[rows] = np.add.reduceat(g.take(rows, 0), first, axis=0).take(nth, 0)
        pull1, pull2 = s.l2 * len(rows1) / k1[i], s.l2 * len(rows2) / k2[i]
        squares = np.einsum("ij,ij->i", p[:, :-1], p[:, :-1])
        pulled += n * (pull1 * squares[:n].dot(one1[at:at + n]) + pull2 * squares[n:].dot(one2[at:at + n]))
        np.multiply(u, 2 * pull1, out=t[:n])
        np.multiply(q, 2 * pull2, out=t[n:])
        t[:, -1] = 0
        g += t
        np.multiply(got[:, 1], BETA1, out=m)
        m += np.multiply(g, 1 - BETA1, out=t)
        np.multiply(got[:, 2], BETA2, out=v)
        np.multiply(g, g, out=t)
        t *= 1 - BETA2
        v += t
        np.sqrt(v, out=t)
        t += TINY
        np.divide(m, t, out=t)
        t1, t2, t0 = t1 + 1, t2 + 1, t0 + 1
        t[:n] *= _rate(s.rate, t1)
        t[n:] *= _rate(s.rate, t2)
        got[:, 1], got[:, 2] = m, v
        np.subtract(p, t, out=got[:, 0])
        put1[ia], put2[ib] = put[:n], put[n:2 * n]
        gw, gc = float(dz.dot(inner)), float(dz.sum())
        mw, mc = BETA1 * mw + (1 - BETA1) * gw, BETA1 * mc + (1 - BETA1) * gc
        vw, vc = BETA2 * vw + (1 - BETA2) * gw * gw, BETA2 * vc + (1 - BETA2) * gc * gc
        w -= _rate(s.rate, t0) * mw / (math.sqrt(vw) + TINY)
        c -= _rate(s.rate, t0) * mc / (math.sqrt(vc) + TINY)
    for x, t in ((one, t1), (two, t2), (outer, t0)):
        x["step"][0] = t
    outer.update(w=np.array(w), m_w=np.array(mw), v_w=np.array(vw), c=np.array(c), m_c=np.array(mc), v_c=np.array(vc))
    losses = np.maximum(zs, 0) - zs * y + np.log1p(np.exp(-np.abs(zs)))
    return float(losses.sum()) + pulled, len(y)


def chunk_order(s: Settings, epoch: int, stratum: int, chunk: int, n: int) -> np.ndarray:
    return np.random.default_rng([s.seed, epoch, stratum, chunk]).permutation(n)


def _pass(s: Settings, epoch: int, stratum: int, part: int, body: bytes, one, two, outer) -> tuple[float, int]:
    rows = np.frombuffer(body, "<i4").reshape(-1, 3)
    order = chunk_order(s, epoch, stratum, part, len(rows))
    return train_chunk(one, two, outer, rows[:, 0], rows[:, 1], rows[:, 2].astype(float), s, order)


# rows of the exchange: what a stratum needs, in the order it needs it
_DONE = "kind int, block int, data binary, loss array<double>, rows long, outer binary"


def _turn(s: Settings, epoch: int, turn: int, blocks: int, laps: int, outer: bytes):
    """Both blocks (kind 0 and 1), then the chunks (kind 2), lap by lap -> both
    blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close():
            home, one, two, out, losses, n = held
            kept = [_dumped(one), _dumped(two)]
            return pa.RecordBatch.from_arrays(
                [pa.array([0, 1], pa.int32()), pa.array([home, (home + turn) % blocks], pa.int32()), pa.array(kept, pa.binary()),
                 pa.array([losses, []], pa.list_(pa.float64())), pa.array([n, 0], pa.int64()),
                 pa.array([pickle.dumps(out), None], pa.binary())],
                names=["kind", "block", "data", "loss", "rows", "outer"])

        for batch in batches:
            for home, kind, lap, part, data in zip(*(batch.column(c).to_pylist() for c in ("home", "kind", "lap", "part")),
                                                   batch.column("data")):
                if held is None or held[0] != home:
                    if held:
                        yield close()
                    held = [home, None, None, pickle.loads(outer), [0.0] * laps, 0]
                body = data.as_py()
                if kind < 2:
                    held[1 + kind] = _loaded(body)
                    continue
                loss, n = _pass(s, epoch + lap, home * blocks + (home + turn) % blocks, part, body, *held[1:4])
                held[4][lap] += loss
                held[5] += n
        if held:
            yield close()
    return run


def _chunks(blocks: int):
    """(a, b, y) sorted by stratum -> chunks of positions inside the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, stratum, kept, size = TaskContext.get().partitionId() << 32, None, [], 0

        def close():
            nonlocal part
            part += 1
            data = np.concatenate(kept).astype("<i4").tobytes()
            i, j = divmod(int(stratum), blocks)
            return pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()), pa.array([data], pa.binary())],
                names=["i", "j", "part", "data"])

        for batch in batches:
            a, b, y, own = (batch.column(c).to_numpy() for c in ("a", "b", "y", "stratum"))
            rows = np.stack((a // blocks, b // blocks, y), 1)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for x, z in zip(cuts, cuts[1:]):
                if z > x:
                    if stratum != own[x] or size >= CHUNK:
                        if kept:
                            yield close()
                        stratum, kept, size = own[x], [], 0
                    kept.append(rows[x:z])
                    size += z - x
        if kept:
            yield close()
    return run


class Folder:
    """Files of blocks and strata in the shared folder.  Every file is written
    under a name of its own and counts once its task reports it, so a retried
    task does no harm."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def new(cls, spark) -> Folder | None:
        """None where there is no shared folder or only Spark can reach it."""
        if not configured_dir(spark):
            return None
        own = cls(f"{checkpoint_dir(spark).rstrip('/')}/factors-{uuid.uuid4().hex}")
        try:
            fs, path = own._at()
            fs.create_dir(path)
        except (pa.ArrowException, OSError):
            return None
        return own

    def _at(self):
        return pafs.FileSystem.from_uri(self.uri)

    def write(self, bodies) -> tuple[str, list[tuple[int, int]]]:
        """A new file of ``bodies``: its name and where each lies in it."""
        fs, path = self._at()
        name, places, at = uuid.uuid4().hex, [], 0
        with fs.open_output_stream(f"{path}/{name}") as f:
            for body in bodies:
                f.write(body)
                places.append((at, len(body)))
                at += len(body)
        return name, places

    def read(self, name: str, place: tuple[int, int] | None = None) -> bytes:
        fs, path = self._at()
        with fs.open_input_file(f"{path}/{name}") as f:
            return f.read() if place is None else f.read_at(place[1], place[0])

    def drop(self, names) -> None:
        fs, path = self._at()
        for name in names:
            try:
                fs.delete_file(f"{path}/{name}")
            except FileNotFoundError:
                pass

    def store(self, chunks: DataFrame) -> dict[tuple[int, int], list[tuple[int, str, tuple[int, int]]]]:
        """The chunks of :func:`_chunks`, a file a task: (i, j) -> (part, name,
        place) in order of parts."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: list[list[int]] = [[], [], []]

            def bodies():
                for batch in batches:
                    for k, c in zip(keys, ("i", "j", "part")):
                        k += batch.column(c).to_pylist()
                    yield from (d.as_py() for d in batch.column("data"))
            name, places = self.write(bodies())
            if not places:
                self.drop([name])
            at, size = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()),
                 pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())],
                names=["i", "j", "part", "name", "at", "size"])

        found: dict = {}
        for r in chunks.mapInArrow(run, "i int, j int, part long, name string, at long, size long").collect():
            found.setdefault((r["i"], r["j"]), []).append((r["part"], r["name"], (r["at"], r["size"])))
        return {k: sorted(v) for k, v in found.items()}

    def turn(self, spark, s: Settings, epoch: int, turn: int, blocks: int, laps: int, outer: bytes, members: int,
             names: list[list[str | None]], strata: dict):
        """One turn, a task a stratum: (block of side 1, losses, rows, outer
        numbers, names of both new block files).  ``names``: the files of both
        sides' blocks, None for one not begun."""
        plan = [(names[0][i], names[1][(i + turn) % blocks], strata.get((i, (i + turn) % blocks), [])) for i in range(blocks)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    j, (*files, chunks) = (i + turn) % blocks, plan[i]
                    one, two = (_loaded(self.read(name)) if name else start_block(kind, k, len(range(k, members, blocks)), s)
                                for kind, (k, name) in enumerate(zip((i, j), files)))
                    out, losses, n = pickle.loads(outer), [0.0] * laps, 0
                    for lap in range(laps):
                        for part, name, place in chunks:
                            loss, k = _pass(s, epoch + lap, i * blocks + j, part, self.read(name, place), one, two, out)
                            losses[lap] += loss
                            n += k
                    made = [self.write([_dumped(x)])[0] for x in (one, two)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([losses], pa.list_(pa.float64())), pa.array([n], pa.int64()),
                         pa.array([pickle.dumps(out)], pa.binary()), pa.array([made], pa.list_(pa.string()))],
                        names=["block", "loss", "rows", "outer", "names"])

        # in order of blocks, so that sums over them do not depend on who ends first
        return sorted(spark.range(0, blocks, 1, blocks).mapInArrow(
            run, "block int, loss array<double>, rows long, outer binary, names array<string>").collect(), key=lambda r: r["block"])

    def table(self, spark, names: list[list[str]]) -> DataFrame:
        """(kind, block, data) of the blocks in the files ``names``."""
        rows = spark.createDataFrame([(kind, k, name) for kind, own in enumerate(names) for k, name in enumerate(own)],
                                     "kind int, block int, name string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, name in enumerate(batch.column("name").to_pylist()):
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column("kind"), one.column("block"), pa.array([self.read(name)], pa.binary())],
                                                     names=["kind", "block", "data"])
        return rows.mapInArrow(run, "kind int, block int, data binary")


@dataclass
class Embedding:
    """A fitted model: blocks of both sides (kind, block, data), outer numbers
    and the loss of every epoch; the files of the blocks, if they are files."""
    blocks: int
    state: DataFrame
    outer: dict[str, np.ndarray]
    history: list[float]
    factors: int
    folder: Folder | None = None
    names: list[list[str]] | None = None

    def side(self, kind: int) -> DataFrame:
        """(idx, factors, bias) of a side."""
        blocks = self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                    p = _loaded(data.as_py())
                    n, width = p["f"].shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(n, dtype=np.int64) * blocks + block),
                         pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(p["f"].reshape(-1))),
                         pa.array(p["b"])], names=["idx", "factors", "bias"])
        return (self.state.where(F.col("kind") == kind).select("block", "data")
                .mapInArrow(run, "idx long, factors array<double>, bias double"))

    def score(self, pairs: DataFrame, a: str, b: str, out: str = "pred") -> DataFrame:
        """``pairs`` (with the indices ``a`` and ``b``, NULL if unknown) plus
        the probability, NULL where an index is unknown."""
        if self.folder:
            return self._scored(pairs, a, b, out)
        one = materialize(self.side(0)).select(F.col("idx").alias(a), F.col("factors").alias("_f1"), F.col("bias").alias("_b1"))
        two = materialize(self.side(1)).select(F.col("idx").alias(b), F.col("factors").alias("_f2"), F.col("bias").alias("_b2"))
        dot = F.aggregate(F.zip_with("_f1", "_f2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        z = F.lit(float(self.outer["w"])) * (dot + F.col("_b1") + F.col("_b2")) + F.lit(float(self.outer["c"]))
        return (pairs.join(one, a, "left").join(two, b, "left")
                .withColumn(out, 1 / (1 + F.exp(-z))).drop("_f1", "_f2", "_b1", "_b2"))


    def _scored(self, pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
        """:meth:`score` by block pairs: the pairs are shuffled, not the factors."""
        blocks, folder, names = self.blocks, self.folder, self.names
        w, c = float(self.outer["w"]), float(self.outer["c"])
        schema = StructType([*pairs.schema.fields, StructField(out, DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = [(None, None), (None, None)]

            def own(kind: int, block: int):
                if held[kind][0] != block:
                    held[kind] = (None, None)
                    p = _loaded(folder.read(names[kind][block]))
                    held[kind] = (block, p["rows"][:, 0].copy())
                return held[kind][1]

            for batch in batches:
                ia, ib, stratum = (batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in ("_a", "_b", "_stratum"))
                z, known = np.zeros(len(ia)), stratum >= 0
                cuts = [0, *(np.flatnonzero(stratum[1:] != stratum[:-1]) + 1).tolist(), len(stratum)]
                for x, y in zip(cuts, cuts[1:]):
                    if y > x and known[x]:
                        i, j = divmod(int(stratum[x]), blocks)
                        u, v = own(0, i), own(1, j)
                        for at in range(x, y, PAIRS):
                            to = min(y, at + PAIRS)
                            p, q = u.take(ia[at:to] // blocks, 0), v.take(ib[at:to] // blocks, 0)
                            z[at:to] = w * (np.einsum("ij,ij->i", p[:, :-1], q[:, :-1]) + p[:, -1] + q[:, -1]) + c
                e = np.exp(-np.abs(z))
                pred = np.where(z >= 0, 1.0, e) / (1 + e)
                kept = batch.select(schema.names[:-1]).columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.float64(), mask=~known)], names=schema.names)

        one, two = F.col(a).cast("long"), F.col(b).cast("long")
        plain = [f.name for f in pairs.schema.fields if "map<" not in f.dataType.simpleString()]
        salt = F.pmod(F.xxhash64(*plain), F.lit(8))              # a hot member's pairs go to many tasks
        dealt = pairs.select("*", one.alias("_a"), two.alias("_b"), (one % blocks * blocks + two % blocks).alias("_stratum"))
        return dealt.repartition("_stratum", salt).sortWithinPartitions("_stratum").mapInArrow(run, schema)


def fit(rows: DataFrame, members: int, settings: Settings = Settings(), epochs: int = 100, patience: int | None = 5,
        tol: float = 0.0, blocks: int | None = None) -> Embedding:
    """Learn from ``rows`` (a, b: indices 0 to ``members`` - 1; y: 0 or 1)."""
    spark = rows.sparkSession
    data = rows.select(F.col("a").cast("int"), F.col("b").cast("int"), F.col("y").cast("int"))
    folder = Folder.new(spark)
    if blocks is None:
        blocks = _blocks(members, data.count(), spark.sparkContext.defaultParallelism, folder is not None)
    s, nb = settings, blocks
    stratum = (F.col("a") % nb) * nb + F.col("b") % nb
    # salted, so that a hot member's stratum is chunked by many tasks
    salt = F.pmod(F.xxhash64("a", "b", "y"), F.lit(8))
    chunks = (data.withColumn("stratum", stratum.cast("long")).repartition(F.col("stratum"), salt)
              .sortWithinPartitions("stratum", "a", "b", "y").mapInArrow(_chunks(nb), "i int, j int, part long, data binary"))
    outer, history, epoch = start_outer(s), [], 0
    turns = _FileTurns(spark, folder, chunks, members, nb, s) if folder else _TableTurns(spark, chunks, members, nb, s)
    while epoch < epochs:
        laps = min(LAPS, epochs - epoch) if nb == 1 else 1
        losses, n = np.zeros(laps), 0
        for turn in range(nb):
            found = turns.run(epoch, turn, laps, pickle.dumps(outer))                       # one row a block
            weight = sum(r["rows"] for r in found)
            if weight:
                each = [(r["rows"] / weight, pickle.loads(bytes(r["outer"]))) for r in found if r["rows"]]
                outer = {k: np.asarray(sum(w * o[k] for w, o in each)) for k in outer}
            losses, n = losses + sum(np.array(r["loss"]) for r in found), n + weight / laps
        history += [float(x) / n if n else 0.0 for x in losses]
        epoch += laps
        if patience is not None and len(history) > patience and min(history[:-patience]) - min(history[-patience:]) <= tol:
            break
    return turns.fitted(outer, history)


def _blocks(members: int, rows: int, slots: int, files: bool) -> int:
    """As many blocks as members ask for; by the rows up to a block a slot, as
    strata beyond them wait.  Turns over files are short: a quarter of the rows
    is enough for them."""
    if not files:
        return max(1, math.ceil(members / BLOCK_MEMBERS), math.ceil(math.sqrt(rows / STRATUM_ROWS)))
    asked = max(1, math.ceil(members / BLOCK_MEMBERS), min(slots, math.ceil(math.sqrt(4 * rows / STRATUM_ROWS))))
    return asked if asked <= slots else math.ceil(asked / slots) * slots


class _FileTurns:
    """Turns over the files of a :class:`Folder`; of every block the file of
    the last turn is kept."""

    def __init__(self, spark, folder: Folder, chunks: DataFrame, members: int, blocks: int, s: Settings):
        self.spark, self.folder, self.members, self.blocks, self.s = spark, folder, members, blocks, s
        self.strata = folder.store(chunks)
        self.names: list[list[str | None]] = [[None] * blocks, [None] * blocks]

    def run(self, epoch: int, turn: int, laps: int, outer: bytes):
        found = self.folder.turn(self.spark, self.s, epoch, turn, self.blocks, laps, outer, self.members, self.names, self.strata)
        old = [name for own in self.names for name in own if name]
        self.names = [list(own) for own in self.names]
        for r in found:
            self.names[0][r["block"]], self.names[1][(r["block"] + turn) % self.blocks] = r["names"]
        self.folder.drop(old)
        return found

    def fitted(self, outer, history) -> Embedding:
        self.folder.drop({name for own in self.strata.values() for _, name, _ in own})
        if not history:                              # no epoch: the blocks as they start
            self.names = [[self.folder.write([_dumped(start_block(kind, k, len(range(k, self.members, self.blocks)), self.s))])[0]
                           for k in range(self.blocks)] for kind in (0, 1)]
        return Embedding(self.blocks, self.folder.table(self.spark, self.names), outer, history, self.s.factors, self.folder, self.names)


class _TableTurns:
    """Turns over tables: without a shared folder."""

    def __init__(self, spark, chunks: DataFrame, members: int, nb: int, s: Settings):
        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column(0).to_pylist()
                kept = [_dumped(start_block(k // nb, k % nb, len(range(k % nb, members, nb)), s)) for k in n]
                yield pa.RecordBatch.from_arrays([pa.array([k // nb for k in n], pa.int32()), pa.array([k % nb for k in n], pa.int32()),
                                                  pa.array(kept, pa.binary())], names=["kind", "block", "data"])

        strata = materialize(chunks)
        self.turns = [strata] if nb == 1 else [materialize(strata.where((F.col("i") + turn) % nb == F.col("j"))) for turn in range(nb)]
        self.state = materialize(spark.range(2 * nb).mapInArrow(first, "kind int, block int, data binary"))
        self.blocks, self.s, self.older = nb, s, []

    def run(self, epoch: int, turn: int, laps: int, outer: bytes):
        nb = self.blocks
        home = F.when(F.col("kind") == 0, F.col("block")).otherwise((F.col("block") - turn + nb) % nb)
        work = self.state.select(home.cast("int").alias("home"), "kind", F.lit(0).alias("lap"), F.lit(0).cast("long").alias("part"),
                                 "data").unionByName(
            self.turns[turn].select(F.col("i").alias("home"), F.lit(2).alias("kind"),
                                    F.explode(F.sequence(F.lit(0), F.lit(laps - 1))).alias("lap"), "part", "data"))
        done = materialize(work.repartitionById(nb, "home").sortWithinPartitions("home", "kind", "lap", "part")
                           .mapInArrow(_turn(self.s, epoch, turn, nb, laps, outer), _DONE))
        found = done.where("kind = 0").select("block", "loss", "rows", "outer").orderBy("block").collect()
        self.older.append(self.state)
        self.state = done.select("kind", "block", "data")
        while len(self.older) > 2:
            self.older.pop(0).unpersist()
        return found

    def fitted(self, outer, history) -> Embedding:
        return Embedding(self.blocks, self.state, outer, history, self.s.factors)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
