"""Gradient-boosted trees on a table of binned cells.

One aggregate over the training rows gives every feature its cuts, a second
one the cells: the distinct binned feature vectors with the number of rows per
fold and label.  Rows of a cell are alike to every tree, so all that boosting
needs - gradient and hessian sums per (node, feature, bin) - comes from the
cells, whose number depends on the bins and not on the rows.

A search fits each distinct run once: points that resolve to the same trees
(equal features per node, depth and so on) share their runs, and a point with
fewer trees is a prefix of the longest one, scored on the way.

* Up to ``CELL_ROWS`` (cell, fold, label) rows, counted before, the cells are
  sent to the executors and every run is a task.
* Beyond that the cells stay where they are: all open runs grow in lock-step,
  one aggregate of left children's histograms per level (the right child is
  the parent less the left one), margins are kept beside the cells.

Both grow the same trees, since sums are exact: gradients are rounded to a
binary fraction so fine that all sums are whole numbers below 2^53
(2^-40 up to some thousand rows, 2^-22 at a thousand million).

Two kinds of trees (:class:`Recipe`):

* first order: regression trees on the residuals by the squared difference of
  the children's means, leaves by one Newton step, every node draws its
  features; starts at the log odds of the labels;
* second order: gain and leaves from gradient and hessian sums with an L2
  penalty, a least hessian sum per child, every tree draws its rows (a
  binomial draw per cell, fold and label: what independent draws of its rows
  amount to) and its columns; starts at 0.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_BINS = 64
CELL_ROWS = 200_000      # rows of the cell table that are sent to tasks
FEW_CUTS = 4             # a value is compared with so many cuts one by one
SYNC = 10                # trees between two written states of the lock-step
ALL = -1                 # fold of a run on all rows


@dataclass(frozen=True)
class Recipe:
    trees: int
    depth: int
    rate: float = 0.1
    per_node: int | None = None      # features a node draws (None: all)
    columns: int | None = None       # features a tree draws (None: all)
    bag: float = 1.0                 # share of rows a tree draws
    second_order: bool = False
    l2: float = 0.0
    min_child: float = 0.0           # least hessian sum of a child (second order)
    seed: int = 0


# ---- bins and cells -------------------------------------------------------

def feature_cuts(train: DataFrame, features: str = "features", max_bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending cuts per feature, halfway between its least value, greatest
    value and quantiles: x falls in the bin of the number of cuts below it."""
    row = train.select(vector_to_array(features).alias("x"))
    width = row.agg(F.max(F.size("x"))).first()[0] or 0
    probs = [i / max_bins for i in range(1, max_bins)]
    marks = row.agg(*[F.struct(F.min(F.get("x", F.lit(i))).alias("lo"), F.max(F.get("x", F.lit(i))).alias("hi"),
                               F.percentile_approx(F.get("x", F.lit(i)), probs, 10_000).alias("q")).alias(f"f{i}")
                      for i in range(width)]).first() if width else []
    out = []
    for m in marks:
        values = sorted({m["lo"], m["hi"], *(m["q"] or [])}) if m["lo"] is not None else []
        if len(values) > max_bins:
            values = values[:max_bins - 1] + values[-1:]
        out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
    return out or [[]]


def cell_of(cuts: Sequence[Sequence[float]], x: str = "_x"):
    """The binned vector as an array of bin numbers, from the array ``x``: the
    cuts below a value are counted by halving.  (A compiled comparison per cut
    makes a method that the JVM is too large to translate and interprets.)"""
    def below(value, cut: Sequence[float]):
        if len(cut) < FEW_CUTS:
            return sum(((value > F.lit(float(c))).cast("int") for c in cut), F.lit(0))
        marks, halves = F.lit([float(c) for c in cut]), F.lit([1 << k for k in reversed(range(len(cut).bit_length()))])
        # behind the last cut there is none: NULL, not below
        return F.aggregate(halves, F.lit(0), lambda n, half: F.when(value > F.get(marks, n + half - 1), n + half).otherwise(n))

    return F.array(*[below(F.coalesce(F.get(x, F.lit(i)), F.lit(float("-inf"))), cut) for i, cut in enumerate(cuts)])


def with_cells(df: DataFrame, cuts: Sequence[Sequence[float]], features: str = "features", out: str = "_cell") -> DataFrame:
    return df.withColumn("_x", vector_to_array(features)).withColumn(out, cell_of(cuts)).drop("_x")


class Layout:
    """Where the bins of the features lie in one histogram."""

    def __init__(self, bins: Sequence[int]):
        self.bins = list(bins)
        self.first = np.concatenate(([0], np.cumsum(self.bins)[:-1])).astype(np.int64)
        self.size = int(np.sum(self.bins))
        self.feature = np.repeat(np.arange(len(self.bins)), self.bins)
        self.bin = np.arange(self.size) - self.first[self.feature]
        self.cuttable = self.bin < np.array(self.bins)[self.feature] - 1     # a cut behind the last bin parts nothing


@dataclass
class Cells:
    """Cells in a fixed order with the entries (cell, fold, label, rows)."""
    x: np.ndarray
    cell: np.ndarray
    fold: np.ndarray
    label: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Cells:
        lists = table["cell"].combine_chunks()
        n = table.num_rows
        flat = lists.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int32)
        fold, label, rows = (table[c].to_numpy() for c in ("fold", "label", "rows"))
        order = np.lexsort((label, fold, *flat.T[::-1]))
        x, cell = np.unique(flat[order], axis=0, return_inverse=True)
        return cls(x, cell.reshape(-1), fold[order], label[order].astype(bool), rows[order].astype(np.int64))

    def held(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.fold == fold
        return tuple(np.bincount(self.cell[m], self.rows[m], len(self.x)) for m in (own & self.label, own & ~self.label))


def cell_table(train: DataFrame, cuts, features: str = "features", label: str = "label", fold: str | None = "fold") -> DataFrame:
    """(cell, fold, label, rows): one distributed aggregate."""
    return with_cells(train, cuts, features).groupBy(F.col("_cell").alias("cell"),
                         (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                         (F.col(label) > 0.5).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


# ---- trees ----------------------------------------------------------------

def _hashed(*parts) -> np.ndarray:
    """A 64-bit number from whole numbers (splitmix steps), for draws that do
    not depend on where they are made."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h + np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


@dataclass
class Tree:
    """A complete binary tree in heap order; ``feature`` is -1 at leaves."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n))

    def step(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One level down; rows at a leaf stay."""
        f = self.feature[at]
        right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
        return np.where(f >= 0, 2 * at + 1 + right, at)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (self.feature[at] >= 0).any():
            at = self.step(at, x)
        return at


def scale_for(rows: int) -> float:
    """Gradients are whole multiples of 1 / scale; their sums stay below 2^53."""
    return float(2 ** max(0, min(40, 52 - int(rows).bit_length())))


def residuals(margin: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled 1 - p, p and p (1 - p), as whole numbers."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((1 - p) * scale), np.rint(p * scale), np.rint(p * (1 - p) * scale)


def gradients(parts, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Rows, sum of (label - p) and sum of p (1 - p) per cell, scaled."""
    up, down, curve = parts
    n = pos + neg
    return np.stack((n, pos * up - neg * down, n * curve), 1)


def histogram(x: np.ndarray, node: np.ndarray, sums: np.ndarray, layout: Layout, nodes: int) -> np.ndarray:
    """[nodes, bins, 3] sums over the rows by node (-1: none) and bin."""
    own = (node >= 0) & (sums[:, 0] > 0)
    at = ((x[own] + layout.first) + (node[own] * layout.size)[:, None]).reshape(-1)
    width = x.shape[1]
    out = np.empty((nodes * layout.size, 3))
    for k in range(3):
        out[:, k] = np.bincount(at, np.repeat(sums[own, k], width), nodes * layout.size)
    return out.reshape(nodes, layout.size, 3)


def growing(recipe: Recipe, number: int, layout: Layout, scale: float):
    """Grows tree ``number``.  A generator: yields ``(level, tree)`` and is
    sent the sums per bin of that level's left children (of the root at level
    0), at the last level ``[nodes, 1, 3]``; returns the tree."""
    tree = Tree.stump(recipe.depth)
    width = len(layout.bins)
    allowed = np.ones(width, bool)
    if recipe.columns is not None and recipe.columns < width:
        allowed[:] = False
        allowed[np.argsort(_hashed(recipe.seed, 1, number, np.arange(width)), kind="stable")[:recipe.columns]] = True
    parent = None
    for level in range(recipe.depth + 1):
        got = yield level, tree
        if level:
            part = parent if level < recipe.depth else parent[:, :layout.bins[0]].sum(1, keepdims=True)
            hist = np.empty((2 * len(got), *got.shape[1:]))
            hist[0::2], hist[1::2] = got, part - got
        else:
            hist = got
        sums = hist[:, :layout.bins[0]].sum(1) if level < recipe.depth else hist[:, 0]
        base = 2 ** level - 1
        penalty = recipe.l2 * scale
        with np.errstate(divide="ignore", invalid="ignore"):
            tree.value[base:base + len(sums)] = np.where(
                (sums[:, 0] > 0) & (sums[:, 2] + penalty > 0), recipe.rate * sums[:, 1] / (sums[:, 2] + penalty), 0.0)
        if level == recipe.depth:
            return tree
        nodes = np.flatnonzero(sums[:, 0] > 0)
        feature, cut = _best(recipe, number, layout, hist[nodes], sums[nodes], base + nodes, allowed, scale)
        tree.feature[base + nodes], tree.cut[base + nodes] = feature, cut
        parent = hist
        parent[nodes[feature < 0]] = 0
        if not (feature >= 0).any():
            return tree


def _best(recipe, number, layout, hist, sums, heap, allowed, scale) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of the best split of every node, feature -1 where none gains."""
    cum = np.cumsum(hist, axis=1)
    before = layout.first[layout.feature] - 1
    left = cum - np.where((before >= 0)[None, :, None], cum[:, np.maximum(before, 0)], 0)
    right = sums[:, None] - left
    nl, gl, hl = np.moveaxis(left, 2, 0)
    nr, gr, hr = np.moveaxis(right, 2, 0)
    valid = layout.cuttable & allowed[layout.feature] & (nl > 0) & (nr > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if recipe.second_order:
            least, pen = recipe.min_child * scale, recipe.l2 * scale
            valid &= (hl >= least) & (hr >= least)
            whole = sums[:, 1] ** 2 / (sums[:, 2] + pen)
            gain = gl ** 2 / (hl + pen) + gr ** 2 / (hr + pen) - whole[:, None]
        else:
            gain = (gl / nl - gr / nr) ** 2 * (nl * nr / (nl + nr))
    if recipe.per_node is not None and recipe.per_node < len(layout.bins):
        width = len(layout.bins)
        draw = _hashed(recipe.seed, 2, number, heap[:, None], np.arange(width)[None, :])
        place = np.argsort(np.argsort(draw, axis=1, kind="stable"), axis=1, kind="stable")
        usable = np.logical_or.reduceat(valid, layout.first, axis=1)
        chosen = place < recipe.per_node
        # a node that drew no usable feature draws on until one is
        none = ~(chosen & usable).any(1)
        chosen[none] = place[none] == np.where(usable[none], place[none], width).min(1)[:, None]
        valid &= chosen[:, layout.feature]
    gain = np.where(valid & (gain > 0), gain, 0.0)
    best = gain.argmax(1)
    there = gain[np.arange(len(gain)), best] > 0
    return np.where(there, layout.feature[best], -1), np.where(there, layout.bin[best], 0)


# ---- boosting where the cells fit a task ---------------------------------

def start(pos: float, neg: float, recipe: Recipe) -> float:
    if recipe.second_order or pos + neg == 0:
        return 0.0
    p = min(max(pos / (pos + neg), sys.float_info.epsilon), 1 - sys.float_info.epsilon)
    return float(np.log(p / (1 - p)))


def drawn_rows(rows: np.ndarray, recipe: Recipe, number: int) -> np.ndarray:
    """The rows that tree ``number`` draws of each entry: the same in all runs of
    a seed and share."""
    return np.random.Generator(np.random.Philox(key=[recipe.seed, number])).binomial(rows, recipe.bag)


def boost(cells: Cells, layout: Layout, recipe: Recipe, fold: int = ALL,
          marks: Sequence[int] = ()) -> tuple[float, list[Tree], dict[int, int]]:
    """(start, trees, rows of ``fold`` told right after each of ``marks`` trees)."""
    return boost_together(cells, layout, [(recipe, fold)], [marks])[0]


def boost_together(cells: Cells, layout: Layout, runs: Sequence[tuple[Recipe, int]],
                   marks: Sequence[Sequence[int]]) -> list[tuple[float, list[Tree], dict[int, int]]]:
    """:func:`boost` for several runs, a tree of each in turn: what a tree draws
    is drawn once for all."""
    going = {k: boosting(cells, layout, recipe, fold, m) for k, ((recipe, fold), m) in enumerate(zip(runs, marks))}
    found, number = [None] * len(runs), -1
    while going:
        drawn = {}
        for k in list(going):
            recipe = runs[k][0]
            key = (recipe.seed, recipe.bag)
            if recipe.bag < 1 and number >= 0 and key not in drawn:
                drawn[key] = drawn_rows(cells.rows, recipe, number)
            try:
                going[k].send(drawn.get(key) if number >= 0 else None)
            except StopIteration as end:
                found[k] = end.value
                del going[k]
        number += 1
    return found


def boosting(cells: Cells, layout: Layout, recipe: Recipe, fold: int, marks: Sequence[int]):
    """One run as a generator: before every tree it is sent the rows drawn for
    it (None: all); returns what :func:`boost` does."""
    own = cells.fold != fold
    ones, zeros = (np.flatnonzero(own & (cells.label == which)) for which in (True, False))
    there, rows = (cells.cell[ones], cells.cell[zeros]), cells.rows

    def weights(rows):
        return (np.bincount(there[0], rows[ones], len(cells.x)), np.bincount(there[1], rows[zeros], len(cells.x)))

    pos, neg = weights(rows)
    test_pos, test_neg = cells.held(fold)
    scale, first = scale_for(cells.rows.sum()), start(pos.sum(), neg.sum(), recipe)
    margin, trees, right = np.full(len(cells.x), first), [], {}
    has_pos, has_neg = pos > 0, neg > 0
    told = lambda: int(np.where(margin > 0, test_pos, test_neg).sum())
    for number in range(recipe.trees):
        parts = residuals(margin, scale)
        if not ((has_pos & (parts[0] != 0)) | (has_neg & (parts[1] != 0))).any():
            break                    # nothing is left to learn: all further leaves are 0
        drawn = yield
        sums = gradients(parts, pos, neg) if drawn is None else gradients(parts, *weights(drawn))
        at = np.zeros(len(cells.x), np.int64)
        grow = growing(recipe, number, layout, scale)
        level, tree = next(grow)
        try:
            while True:
                if level:
                    at = tree.step(at, cells.x)
                base = 2 ** level - 1
                node = at - base
                node = np.where((node >= 0) & (node % 2 == 0), node // 2, -1) if level else node
                count = max(1, 2 ** (level - 1)) if level else 1
                if level < recipe.depth:
                    got = histogram(cells.x, node, sums, layout, count)
                else:
                    own = node >= 0
                    got = np.stack([np.bincount(node[own], sums[own, k], count) for k in range(3)], 1)[:, None]
                level, tree = grow.send(got)
        except StopIteration as end:
            tree = end.value
        margin = margin + tree.value[_settled(tree, at, cells.x)]
        trees.append(tree)
        if number + 1 in marks:
            right[number + 1] = told()
    for m in marks:
        right.setdefault(m, told())
    return first, trees, right


def _settled(tree: Tree, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    while (tree.feature[at] >= 0).any():
        at = tree.step(at, x)
    return at


# ---- boosting where they do not: all runs in lock-step -------------------

def _sums_task(runs, since, open_trees, layout: Layout, folds: int, scale: float, with_state: bool):
    """Per batch of cells: histograms of every open run's level, or new margins."""
    def read(batch: pa.RecordBatch):
        n = batch.num_rows
        x = batch.column("x").flatten().to_numpy().reshape(n, -1)
        counts = batch.column("counts").flatten().to_numpy().reshape(n, folds, 2)
        margins = batch.column("margins").flatten().to_numpy().reshape(n, len(runs)).copy()
        for r, (recipe, fold) in enumerate(runs):
            for tree in since[r]:
                margins[:, r] += tree.value[tree.leaves(x)]
        return x, counts, margins

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, margins = read(batch)
            flat = pa.array(margins.reshape(-1))
            at = pa.array(np.arange(0, margins.size + 1, len(runs), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("counts"), pa.ListArray.from_arrays(at, flat)],
                                             names=["x", "counts", "margins"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x, counts, margins = read(batch)
            for r, (number, level, tree) in open_trees.items():
                recipe, fold = runs[r]
                rows = counts
                if recipe.bag < 1:
                    key = [recipe.seed, number + (part << 20) + (nth << 42)]
                    rows = np.random.Generator(np.random.Philox(key=key)).binomial(counts, recipe.bag)
                keep = np.arange(folds) != fold
                neg, pos = rows[:, keep, 0].sum(1).astype(float), rows[:, keep, 1].sum(1).astype(float)
                g = gradients(residuals(margins[:, r], scale), pos, neg)
                at = np.zeros(len(x), np.int64)
                for _ in range(level):
                    at = tree.step(at, x)
                node = at - (2 ** level - 1)
                node = np.where((node >= 0) & (node % 2 == 0), node // 2, -1) if level else node
                count = 2 ** (level - 1) if level else 1
                if level < recipe.depth:
                    got = histogram(x, node, g, layout, count).reshape(-1, 3)
                else:
                    own = node >= 0
                    got = np.stack([np.bincount(node[own], g[own, k], count) for k in range(3)], 1)
                slot = np.flatnonzero(got[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r, np.int32)), pa.array(slot), *[pa.array(got[slot, k]) for k in range(3)]],
                    names=["run", "slot", "n", "g", "h"])
    return state if with_state else sums


_SUMS = "run int, slot long, n double, g double, h double"
_STATE = "x array<int>, counts array<long>, margins array<double>"


def boost_spread(table: DataFrame, layout: Layout, runs: Sequence[tuple[Recipe, int]],
                 marks: Sequence[Sequence[int]]) -> list[tuple[float, list[Tree], dict[int, int]]]:
    """:func:`boost` for many runs at once, the cells (``table`` of
    :func:`cell_table`) staying on the executors."""
    spark = table.sparkSession
    per = {(r["fold"], r["label"]): r["rows"] for r in table.groupBy("fold", "label").agg(F.sum("rows").alias("rows")).collect()}
    folds = 1 + max((f for f, _ in per), default=0)
    total = sum(per.values())
    scale = scale_for(total)
    firsts = [start(*[sum(n for (f, la), n in per.items() if la == which and f != fold) for which in (1, 0)], recipe)
              for recipe, fold in runs]
    slots = F.sequence(F.lit(0), F.lit(2 * folds - 1))
    counts = F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    state = materialize(
        table.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct((2 * F.col("fold") + F.col("label")).cast("int"), F.col("rows")))).alias("m"))
        .select(F.col("cell").alias("x"), counts.alias("counts"), F.array(*[F.lit(v) for v in firsts]).alias("margins")))
    trees: list[list[Tree]] = [[] for _ in runs]
    told: list[dict[int, int]] = [{} for _ in runs]
    since: list[list[Tree]] = [[] for _ in runs]

    def written():
        nonlocal state, since
        old, state = state, materialize(state.mapInArrow(
            _sums_task(list(runs), [list(s) for s in since], {}, layout, folds, scale, True), _STATE))
        state.count()
        old.unpersist()
        since = [[] for _ in runs]

    for number in range(max((r.trees for r, _ in runs), default=0)):
        grows, waiting = {}, {}
        for r, (recipe, _) in enumerate(runs):
            if number < recipe.trees:
                grows[r] = growing(recipe, number, layout, scale)
                waiting[r] = next(grows[r])
        done = {}
        while waiting:
            task = _sums_task(list(runs), since, {r: (number, level, tree) for r, (level, tree) in waiting.items()}, layout,
                              folds, scale, False)
            got = state.mapInArrow(task, _SUMS).groupBy("run", "slot").agg(*[F.sum(c).alias(c) for c in "ngh"]).toArrow()
            run, slot = got["run"].to_numpy(), got["slot"].to_numpy()
            values = np.stack([got[c].to_numpy() for c in "ngh"], 1)
            for r, (level, tree) in list(waiting.items()):
                nodes = 2 ** (level - 1) if level else 1
                width = layout.size if level < runs[r][0].depth else 1
                sums = np.zeros((nodes * width, 3))
                sums[slot[run == r]] = values[run == r]
                try:
                    waiting[r] = grows[r].send(sums.reshape(nodes, width, 3))
                except StopIteration as end:
                    done[r] = end.value
                    del waiting[r]
        for r, tree in done.items():
            trees[r].append(tree)
            since[r].append(tree)
        wanted = [r for r in done if number + 1 in marks[r]]
        if (number + 1) % SYNC == 0 or wanted:
            written()
        if wanted:
            hit = state.select([F.expr(
                f"aggregate(sequence(0, {folds - 1}), 0L, (s, f) -> s + if(f = {runs[r][1]}, if(margins[{r}] > 0, "
                f"counts[2 * f + 1], counts[2 * f]), 0L))").alias(f"r{r}") for r in wanted]).groupBy().sum().first()
            for r, h in zip(wanted, hit):
                told[r][number + 1] = int(h or 0)
    return [(f, t, c) for f, t, c in zip(firsts, trees, told)]


# ---- models and searches --------------------------------------------------

@dataclass
class Boosted:
    """A fitted model: cuts of the features, start, trees."""
    cuts: list[list[float]]
    first: float
    trees: list[Tree]
    features: str = "features"

    def _per_cell(self, df: DataFrame, made, schema: str, then: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
        """``df`` with what ``made`` and ``then`` give per cell: each distinct
        cell once, fixed and joined back.  Up to ``CELL_ROWS`` cells are sent to
        the rows; beyond, adaptive execution splits a cell that many rows share."""
        from ..session import materialize       # the class goes to the executors by value, the library does not
        d = with_cells(df, self.cuts, self.features)
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                x = lists.flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([lists, *made(x)], names=["_key", *names])
        cells = materialize(then(d.select("_cell").distinct().mapInArrow(run, f"_key array<int>, {schema}")))
        if cells.count() <= CELL_ROWS:
            cells = F.broadcast(cells)
        return d.join(cells, F.col("_cell") == F.col("_key")).drop("_cell", "_key")

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.first)
        for tree in self.trees:
            out += tree.value[tree.leaves(x)]
        return out

    def transform(self, df: DataFrame, out: str = "Pred1") -> DataFrame:
        """``df`` with the probability of label 1."""
        own = replace(self)
        return self._per_cell(df, lambda x: [pa.array(1 / (1 + np.exp(-np.clip(own.margins(x), -500, 500))))],
                              f"{out} double")

    def leaf_slots(self) -> list[np.ndarray]:
        """For every tree: heap number of a leaf -> its slot (-1: no leaf).
        One numbering for all trees, in order of tree and leaf."""
        out, base = [], 0
        for t in self.trees:
            reach = np.zeros(len(t.feature), bool)
            reach[0] = True
            inner = np.flatnonzero(t.feature >= 0)
            reach[2 * inner + 1] = reach[2 * inner + 2] = True
            leaf = reach & (t.feature < 0)
            out.append(np.where(leaf, base + np.cumsum(leaf) - 1, -1))
            base += int(leaf.sum())
        return out

    @property
    def slots(self) -> int:
        return sum(int((s >= 0).sum()) for s in self.leaf_slots())

    def encode(self, df: DataFrame, leaf: str = "leaf_ids", slot: str = "set_slots",
               then: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
        """``df`` with the leaf (heap number) it reaches in every tree and the
        slots of those leaves, one per tree (and what ``then`` makes of both)."""
        own, table = replace(self), self.leaf_slots()

        def made(x):
            at = np.stack([t.leaves(x) for t in own.trees], 1) if own.trees else np.zeros((len(x), 0), np.int64)
            slots = np.stack([s[at[:, i]] for i, s in enumerate(table)], 1) if own.trees else at
            cut = pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)) if at.shape[1] else pa.array(
                np.zeros(len(x) + 1, np.int32))
            return [pa.ListArray.from_arrays(cut, pa.array(v.reshape(-1).astype(np.int32))) for v in (at, slots)]
        return self._per_cell(df, made, f"{leaf} array<int>, {slot} array<int>", then)

    def leaf_vectors(self, df: DataFrame, out: str = "leaves", with_features: str | None = None) -> DataFrame:
        """``df`` with one sparse vector: 1 in the slot of every tree's leaf
        and, in ``with_features``, the same vector with the features behind."""
        size = self.slots
        one_hot = F.udf(lambda s: Vectors.sparse(size, s, [1.0] * len(s)), VectorUDT())
        d = self.encode(df, "_leaf", "_slot", lambda cells: cells.withColumn(out, one_hot("_slot")).drop("_leaf", "_slot"))
        if with_features:
            from pyspark.ml.feature import VectorAssembler
            d = VectorAssembler(inputCols=[out, self.features], outputCol=with_features).transform(d)
        return d


def fit(train: DataFrame, make: Callable[[int], Recipe], features: str = "features", label: str = "label") -> Boosted:
    """One model on all rows; ``make`` gets the number of features."""
    cuts = feature_cuts(train, features)
    (first, trees, _), = _runs(cell_table(train, cuts, features, label, None), cuts, [(make(len(cuts)), ALL)], [()])
    return Boosted(cuts, first, trees, features)


def share_of(share: float, width: int) -> int | None:
    """The number of features a share of ``width`` means: rounded down, one at
    least; None for all."""
    n = max(1, int(share * width))
    return None if n >= width else n


def _runs(table: DataFrame, cuts, runs: Sequence[tuple[Recipe, int]], marks: Sequence[Sequence[int]],
          trees: bool = True) -> list[tuple[float, list[Tree], dict[int, int]]]:
    """Fit all runs; the trees come back only where asked for."""
    spark = table.sparkSession
    layout = Layout([len(c) + 1 for c in cuts])
    table = materialize(table)
    if table.count() > CELL_ROWS:
        return boost_spread(table, layout, runs, marks)
    # shipped by value: the executors need numpy, not this library
    share = spark.sparkContext.broadcast(cloudpickle.dumps(
        (Cells.of(table.toArrow()), layout, list(runs), [tuple(m) for m in marks])))
    # a task a run; runs that draw rows share their draws by task
    tasks = max(1, len(runs))
    if any(recipe.bag < 1 for recipe, _ in runs):
        tasks = min(tasks, 3 * spark.sparkContext.defaultParallelism)
    dealt = sorted(range(len(runs)), key=lambda r: r % tasks)           # deep and shallow runs to every task

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, lay, todo, at = cloudpickle.loads(share.value)
        own = [dealt[i] for batch in batches for i in batch.column(0).to_pylist()]
        for r, (first, grown, right) in zip(own, boost_together(cells, lay, [todo[r] for r in own], [at[r] for r in own])):
            kept = pickle.dumps((first, [(t.feature, t.cut, t.value) for t in grown] if trees else [], right))
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([kept], pa.binary())], names=["run", "found"])

    try:
        found = spark.range(0, len(runs), 1, tasks).mapInArrow(some, "run long, found binary").collect()
    finally:
        share.unpersist()
    by_run = {r["run"]: pickle.loads(bytes(r["found"])) for r in found}
    return [(first, [Tree(*t) for t in grown], right) for first, grown, right in (by_run[r] for r in range(len(runs)))]


@dataclass
class BoostSearch:
    """A finished search: points, mean accuracy over the folds, best model."""
    points: list[dict]
    metrics: list[float]
    model: Boosted
    fits: int                # runs that were fitted, the refit not counted

    @property
    def best(self) -> int:
        return max(range(len(self.metrics)), key=lambda i: self.metrics[i])

    def transform(self, df: DataFrame, out: str = "Pred1") -> DataFrame:
        return self.model.transform(df, out)


def search(train: DataFrame, points: Sequence[dict], make: Callable[[dict, int], Recipe], features: str = "features",
           label: str = "label", fold: str = "fold") -> BoostSearch:
    """Every point on every fold (column ``fold``, numbers from 0), scored by
    accuracy on the fold; the best point's model fitted on all rows.
    ``make`` gets a point and the number of features."""
    cuts = feature_cuts(train, features)
    table = materialize(cell_table(train, cuts, features, label, fold))
    sizes = {r["fold"]: r["rows"] for r in table.groupBy("fold").agg(F.sum("rows").alias("rows")).collect()}
    folds = [f for f in sorted(sizes) if sizes[f] < sum(sizes.values())]
    recipes = [make(p, len(cuts)) for p in points]
    # one run for all points that differ in the number of trees alone
    longest: dict[Recipe, list[int]] = {}
    for recipe in recipes:
        longest.setdefault(replace(recipe, trees=0), []).append(recipe.trees)
    keys = [(key, f) for key in longest for f in folds]
    found = _runs(table, cuts, [(replace(key, trees=max(longest[key])), f) for key, f in keys],
                  [sorted(set(longest[key])) for key, _ in keys], trees=False)
    right = {k: told for k, (_, _, told) in zip(keys, found)}
    metrics = [sum(right[replace(r, trees=0), f][r.trees] / sizes[f] for f in folds) / max(1, len(folds)) for r in recipes]
    best = max(range(len(metrics)), key=lambda i: metrics[i])
    (first, trees, _), = _runs(table, cuts, [(recipes[best], ALL)], [()])
    return BoostSearch(list(points), metrics, Boosted(cuts, first, trees, features), len(keys))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
