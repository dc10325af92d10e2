"""Many regularised linear fits of one table, grown in lock-step.

A search fits every point on every fold.  Fitted one by one each of them passes
over the rows some hundred times; here all open fits share a pass: a task gives
the sums of loss and gradient of every fit over its rows, the driver adds them
up and takes one step of every fit.  The minimised loss is Spark ML's,

    mean loss of the rows + ridge / 2 * |w|^2        (no penalty on the intercept)

with the log loss or the hinge loss, the mean over the rows outside the fit's
fold.  Steps are those of L-BFGS with a line search by the weak Wolfe
conditions, which holds for the kinks of the hinge loss too.

The rows are packed once, ``CHUNK`` to a block: of the columns that hold only two
values in a block (a scaled indicator's 1 may be a little less) each distinct
combination once, as bits.  A pass multiplies
the combinations, not the rows, by those columns' weights.  It sends one row of sums per block partition to
the driver, (features + 2) numbers per fit, however many rows there are.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 8192             # rows of a block
SLICE = 256              # rows whose losses are taken at a time
EXACT = 1e-12            # of a cosine's series
FEW_ROWS = 64            # rows of a combination of two-valued columns that pay for one of its own
VIEWED = 512             # rows of a block whose view is held at a time: they stay in a core's cache
MEMORY = 8               # steps that L-BFGS looks back on
ALL = -1                 # fold of a fit on all rows


@dataclass(frozen=True)
class Fit:
    """``view``: which of the searches' feature maps; ``fold``: the fold left out."""
    view: int
    ridge: float
    fold: int = ALL


# ---- packed rows ------------------------------------------------------------

def pack(data: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> DataFrame:
    """(block): pickled blocks of the rows' features, labels and folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def close():
            x, y, f = (np.concatenate(p) for p in zip(*kept))
            low, high = x.min(0), x.max(0)
            bits = ((x == low) | (x == high)).all(0)
            packed = np.packbits((x == high)[:, bits], axis=1)
            if not packed.shape[1]:
                kinds, kind = packed[:1], np.zeros(len(x), np.int64)
            else:
                kinds, kind = np.unique(packed, axis=0, return_inverse=True)
            kind = kind.reshape(-1)
            by = np.argsort(kind, kind="stable")
            block = (np.flatnonzero(bits), kinds, np.bincount(kind), np.flatnonzero(~bits), x[by][:, ~bits],
                     np.stack((low, high))[:, bits], y[by], f[by])
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y, f = batch.column("y").to_numpy(), batch.column("f").to_numpy()
            for i in range(0, len(x), CHUNK):
                kept.append((x[i:i + CHUNK], y[i:i + CHUNK], f[i:i + CHUNK]))
                size += len(kept[-1][0])
                if size >= CHUNK:
                    yield close()
                    kept, size = [], 0
        if kept:
            yield close()

    rows = data.select(vector_to_array(features).alias("x"), (F.col(label) > 0.5).cast("double").alias("y"),
                       F.col(fold).cast("int").alias("f"))
    return rows.mapInArrow(run, "block binary")


class Rows:
    """The features of a block's rows, in order of their columns of two values."""

    def __init__(self, bits: np.ndarray, kinds: np.ndarray, rows: np.ndarray, rest: np.ndarray, x: np.ndarray,
                 values: np.ndarray):
        self.bits, self.rest, self.rows, self.x = bits, rest, rows, x
        self.kinds = np.where(np.unpackbits(kinds, axis=1, count=len(bits)), values[1], values[0]) if len(bits) else np.zeros((len(rows), 0))
        self.first = np.cumsum(rows) - rows

    def dense(self) -> np.ndarray:
        out = np.empty((len(self.x), len(self.bits) + len(self.rest)))
        out[:, self.bits] = np.repeat(self.kinds, self.rows, axis=0)
        out[:, self.rest] = self.x
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        """The features times ``w``: a combination of two-valued columns once."""
        out = np.repeat(self.kinds @ w[self.bits], self.rows, axis=0)
        out += self.x @ w[self.rest]
        return out

    def summed(self, slope: np.ndarray) -> np.ndarray:
        """The sum over the rows of features times ``slope``."""
        out = np.empty((len(self.bits) + len(self.rest), slope.shape[1]))
        out[self.bits] = self.kinds.T @ np.add.reduceat(slope, self.first, axis=0)
        out[self.rest] = self.x.T @ slope
        return out


class Dense:
    """The same of a matrix."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def summed(self, slope: np.ndarray) -> np.ndarray:
        return self.x.T @ slope


def _rows(data: bytes) -> tuple[Rows, np.ndarray, np.ndarray]:
    *features, y, f = pickle.loads(data)
    return Rows(*features), y, f


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, y, f = _rows(data)
    return rows.dense(), y, f


def _blocks(batches: Iterator[pa.RecordBatch], read=_unpacked):
    for batch in batches:
        for data in batch.column("block"):
            yield read(data.as_py())


class Fourier:
    """The view of :class:`.models.FourierFeatures` with projections ``w``."""

    def __init__(self, w: np.ndarray):
        self.w, self.size = w, 1 / np.sqrt(len(w))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, half = x @ self.w.T, len(self.w)
        out = np.empty((len(x), 2 * half))
        np.cos(at, out=out[:, :half])
        np.sin(at, out=out[:, half:])
        out *= self.size
        return out

    def smooth(self, rows: Rows, cache: dict) -> Smooth | None:
        """The view of a block as polynomials, None where that is no less work:
        projections that reach far, many features of more than two values, or a
        combination of the others for every few rows."""
        if not len(rows.x) or len(rows.rows) * FEW_ROWS > len(rows.x):
            return None
        low, high = rows.x.min(0), rows.x.max(0)
        mid, reach = (low + high) / 2, (high - low) / 2
        own = self.w[:, rows.rest] * reach
        far, degree, left = np.abs(own).sum(1).max(initial=0.0), 0, 1.0
        while True:
            left *= far / (degree + 1)           # the next term of the series, that bounds the rest
            if not left > EXACT:
                break
            degree += 1
            if math.comb(len(reach) + degree, degree) > len(self.w):
                return None
        if degree not in cache:
            cache[degree] = _monomials((rows.x - mid) / np.where(reach > 0, reach, 1.0), degree)
        powers, x = cache[degree]
        terms = np.prod([own.T[i][None] ** powers[:, i, None] / _factorials(powers[:, i, None]) for i in range(len(reach))], axis=0) \
            if len(reach) else np.ones((1, len(self.w)))
        total = powers.sum(1)
        terms = terms * np.where(total // 2 % 2, -1.0, 1.0)[:, None]
        return Smooth(rows, x, terms, total % 2 == 0, rows.kinds @ self.w[:, rows.bits].T + self.w[:, rows.rest] @ mid, self.size)


def fourier(w: np.ndarray) -> Fourier:
    return Fourier(w)


def _factorials(n: np.ndarray) -> np.ndarray:
    return np.cumprod([1.0, *range(1, int(n.max(initial=0)) + 1)])[n]


def _monomials(u: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The exponents of all monomials up to ``degree`` and their values at ``u``."""
    powers = np.array([p for p in product(range(degree + 1), repeat=u.shape[1]) if sum(p) <= degree], int).reshape(-1, u.shape[1])
    place = {tuple(p): i for i, p in enumerate(powers.tolist())}
    x = np.empty((len(powers), len(u)))
    for p, i in place.items():                   # in order: one factor less is there already
        j = next((j for j, n in enumerate(p) if n), None)
        if j is None:
            x[i] = 1.0
        else:
            np.multiply(x[place[(*p[:j], p[j] - 1, *p[j + 1:])]], u[:, j], out=x[i])
    return powers, np.ascontiguousarray(x.T)


class Smooth:
    """Cosines and sines of projections of a block's rows.  A projection is
    a + b, a of the row's combination of two-valued columns, b of the other features;
    cos b and sin b are their series, cut where it is exact to ``EXACT``: even and
    odd ``terms`` of few monomials ``x``, shared by all projections."""

    def __init__(self, rows: Rows, x: np.ndarray, terms: np.ndarray, even: np.ndarray, at: np.ndarray, size: float):
        self.x, self.even, self.odd, self.t_even, self.t_odd = x, even, ~even, terms[even], terms[~even]
        self.cos, self.sin = np.cos(at) * size, np.sin(at) * size
        ends = np.cumsum(rows.rows)
        self.own = [slice(e - n, e) for e, n in zip(ends.tolist(), rows.rows.tolist())]

    def times(self, w: np.ndarray) -> np.ndarray:
        half = self.cos.shape[1]
        c, s, out = w[:half], w[half:], np.empty((len(self.x), w.shape[1]))
        for own, cos, sin in zip(self.own, self.cos[:, :, None], self.sin[:, :, None]):
            by = np.empty((len(self.even), w.shape[1]))
            by[self.even] = self.t_even @ (cos * c + sin * s)
            by[self.odd] = self.t_odd @ (cos * s - sin * c)
            np.matmul(self.x[own], by, out=out[own])
        return out

    def summed(self, slope: np.ndarray) -> np.ndarray:
        half = self.cos.shape[1]
        out = np.zeros((2 * half, slope.shape[1]))
        for own, cos, sin in zip(self.own, self.cos[:, :, None], self.sin[:, :, None]):
            by = self.x[own].T @ slope[own]
            even, odd = self.t_even.T @ by[self.even], self.t_odd.T @ by[self.odd]
            out[:half] += cos * even - sin * odd
            out[half:] += sin * even + cos * odd
        return out


# ---- losses -----------------------------------------------------------------

def log_loss(z: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At the margins ``z`` of at most ``SLICE`` rows: the loss of the rows to
    ``keep`` per fit and the slope per (row, fit), 0 for the others."""
    side = np.where(y > 0.5, -1.0, 1.0)[:, None]
    away = side * z                              # the loss is log(1 + exp(away))
    low = np.exp(-np.abs(away))
    more = 1 + low
    # factors between 1 and 2: their product is finite, its logarithm the sum of theirs
    value = np.log(np.where(keep, more, 1.0).prod(0)) + np.einsum("ij,ij->j", np.maximum(away, 0), keep)
    slope = np.where(away >= 0, 1.0, low)
    slope /= more
    slope *= side
    slope *= keep
    return value, slope


def hinge_loss(z: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = (2 * y - 1)[:, None]
    short = 1 - side * z
    return np.einsum("ij,ij->j", np.maximum(short, 0), keep), np.where(keep & (short > 0), -side, 0.0)


def _summed(packed: DataFrame, views, wanted: dict[int, tuple[int, int, np.ndarray]], each) -> dict[int, np.ndarray]:
    """Per fit the sum over all rows of what ``each`` gives.  ``wanted``: fit ->
    (view, fold, weights with the intercept last)."""
    by_view: dict[int, list[int]] = {}
    for k, (view, _, _) in wanted.items():
        by_view.setdefault(view, []).append(k)
    plan = [(views[v], ks, np.stack([wanted[k][2] for k in ks], 1), np.array([wanted[k][1] for k in ks]))
            for v, ks in sorted(by_view.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for rows, y, f in _blocks(batches, _rows):
            found, x, cache = [], None, {}
            for view, _, w, folds in plan:
                total, whole = None, view.smooth(rows, cache) if view else rows
                if whole is None and x is None:
                    x = rows.dense()
                for i in range(0, len(y), len(y) if whole else VIEWED):
                    own = slice(i, None if whole else i + VIEWED)
                    v = whole or Dense(view(x[own]))
                    z = v.times(w[:-1])
                    z += w[-1]
                    part = each(v, y[own], z, f[own, None] == folds)
                    total = part if total is None else total + part
                found.append(total)
            sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

    total = None
    for row in packed.mapInArrow(run, "sums binary").collect():          # one row a partition
        sums = pickle.loads(bytes(row["sums"]))
        total = sums if total is None else [a + b for a, b in zip(total, sums)]
    return {k: s[:, i] for (_, ks, _, _), s in zip(plan, total or []) for i, k in enumerate(ks)}


# ---- steps ------------------------------------------------------------------

def minimising(width: int, ridge: np.ndarray, max_iter: int, tol: float):
    """A generator: yields weights, is sent (mean loss, its gradient) there,
    returns the weights found.  ``ridge`` is the penalty of every weight."""
    w = np.zeros(width)
    f, g = yield w
    g = g + ridge * w
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for nth in range(max_iter):
        if np.abs(g).max(initial=0.0) < 1e-9:
            break
        d, used = -g, []
        for s, y, rho in reversed(steps):
            a = rho * (s @ d)
            used.append(a)
            d = d - a * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(steps, reversed(used)):
            d = d + (a - rho * (y @ d)) * s
        slope = g @ d
        if not slope < 0:
            d, steps, slope = -g, [], -(g @ g)
        t, low, high = 1.0 if steps else min(1.0, 1 / np.sqrt(g @ g)), 0.0, np.inf
        best = (f, w, g)
        for _ in range(25):
            at = w + t * d
            loss, grad = yield at
            loss, grad = loss + 0.5 * (ridge * at) @ at, grad + ridge * at
            if loss < best[0]:
                best = (loss, at, grad)
            if not loss <= f + 1e-4 * t * slope:
                high = t
            elif grad @ d < 0.9 * slope:
                low = t
            else:
                break
            t = 2 * t if high == np.inf else (low + high) / 2
        old, (f, at, grad) = f, best
        if at is w:
            break                    # no step leads down any more
        s, y = at - w, grad - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[1 - MEMORY:], (s, y, 1 / (s @ y))]
        w, g = at, grad
        if old - f <= tol * max(abs(old), abs(f), 1e-12):
            break
    return w


@dataclass
class Fits:
    """Fitted weights, one row a fit, the intercept last, with what they need
    to be used on the packed rows."""
    packed: DataFrame
    views: Sequence[Callable[[np.ndarray], np.ndarray] | None]
    fits: Sequence[Fit]
    weights: list[np.ndarray]

    def hits(self) -> list[int]:
        """Per fit the rows of its fold that it tells right."""
        found = _summed(self.packed, self.views, {k: (f.view, f.fold, w) for k, (f, w) in enumerate(zip(self.fits, self.weights))},
                        lambda v, y, z, held: ((((z > 0) == (y[:, None] > 0.5)) & held).sum(0))[None])
        return [int(found[k][0]) if k in found else 0 for k in range(len(self.fits))]

    def margins(self, own: Sequence[int]) -> DataFrame:
        """(label, margin) of the rows in the folds of the fits ``own``."""
        views = self.views
        plan = [(self.fits[k].view, self.fits[k].fold, self.weights[k]) for k in own]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, f in _blocks(batches):
                for view, fold, w in plan:
                    rows = f == fold
                    if rows.any():
                        v = views[view](x[rows]) if views[view] else x[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(y[rows]), pa.array(v @ w[:-1] + w[-1])], names=["label", "margin"])
        return self.packed.mapInArrow(run, "label double, margin double")


def fit(packed: DataFrame, fits: Sequence[Fit], sizes: dict[int, int], loss, views=(None,), max_iter: int = 100,
        tol: float = 1e-6) -> Fits:
    """All ``fits`` on the rows of :func:`pack` (read once a step: keep them);
    ``sizes``: rows per fold."""
    # the features' spread, to step in units of it as Spark ML does
    moments = _moments(packed, views)
    total = sum(sizes.values())
    made, asked, weights = {}, {}, [None] * len(fits)
    for k, f in enumerate(fits):
        spread = moments[f.view]
        unit = np.append(1 / spread, 1.0)
        ridge = np.append(f.ridge / spread ** 2, 0.0)
        made[k] = (minimising(len(unit), ridge, max_iter, tol), unit, total - sizes.get(f.fold, 0))
        asked[k] = next(made[k][0])

    def each(v, y, z, held):
        total = np.zeros(z.shape[1])
        for i in range(0, len(z), SLICE):        # the slopes take the margins' place
            own = slice(i, i + SLICE)
            value, z[own] = loss(z[own], y[own], ~held[own])
            total += value
        return np.vstack((total, v.summed(z), z.sum(0)))

    while asked:
        found = _summed(packed, views, {k: (fits[k].view, fits[k].fold, w * made[k][1]) for k, w in asked.items()}, each)
        for k in list(asked):
            steps, unit, n = made[k]
            sums = found.get(k)
            if sums is None:
                sums = np.zeros(len(unit) + 1)
            try:
                asked[k] = steps.send((sums[0] / max(n, 1), sums[1:] * unit / max(n, 1)))
            except StopIteration as end:
                weights[k] = end.value * unit
                del asked[k]
    return Fits(packed, views, list(fits), weights)


def _moments(packed: DataFrame, views) -> list[np.ndarray]:
    """Per view the standard deviation of every feature, 1 where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for x, _, _ in _blocks(batches):
            found = []
            for view in views:
                v = view(x) if view else x
                mean = v.mean(0)
                found.append(np.stack((np.full(v.shape[1], float(len(v))), mean, ((v - mean) ** 2).sum(0))))
            sums = found if sums is None else [_merged(a, b) for a, b in zip(sums, found)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

    total = None
    for row in packed.mapInArrow(run, "sums binary").collect():          # one row a partition
        sums = pickle.loads(bytes(row["sums"]))
        total = sums if total is None else [_merged(a, b) for a, b in zip(total, sums)]
    if total is None:
        return [np.ones(0) for _ in views]
    spread = [np.sqrt(t[2] / np.maximum(t[0], 1)) for t in total]
    return [np.where(s > 0, s, 1.0) for s in spread]


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and summed squares about the mean of two parts together."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    return np.stack((n, a[1] + off * b[0] / n, a[2] + b[2] + off ** 2 * a[0] * b[0] / n))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
