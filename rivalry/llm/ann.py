"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half has its
own centroids (k-means on a bounded sample), and a vector lies in the cell of
its two nearest centroids.  A query walks the centroid pairs in order of their
summed distance - a heap over the two sorted distance lists - until the cells
it passed hold ``probe`` entries (and at least ``cells`` cells).  The entries
of those cells are reranked by the exact cosine in double precision.

``probe`` is measured: the exact neighbours of ``CALIBRATE`` queries, found by
comparing those with all entries in blocks, tell how many entries the walk
passes before their cells; ``probe`` is widened until ``RECALL`` of them are
found.  Every query takes the walk, on tables of any size.

An entry is a distinct vector with the ``k`` + 1 smallest ids that carry it:
more copies of it cannot be in a result, ties going to the smaller id.  Cells
are worked off together up to a block of entries, and in blocks of bounded
numbers of entries and of queries, so a hot cell is many tasks' work and a query
gives ``k`` rows a block, not a cell.  On the driver lie the centroids and the number
of entries of each cell (at most ``MAX_CENTROIDS`` squared numbers).

Cases: vectors that are NULL, empty, zero, of another length than the most
frequent one, or that hold a NULL or non-finite component take no part, as
queries or candidates; NULL ids neither; a repeated id counts as the same row
again and is never its own neighbour; fewer candidates than ``k`` give fewer
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pin

K = 5
PROBE = 3000             # entries that a query looks at, at least
CALIBRATE = 256          # queries whose exact neighbours are found to widen it, at most
RECALL = 0.95            # share of those neighbours that the widened walk finds (0.9 and a margin for the sample)
CELLS = 8                # cells that a query looks at, at least
SAMPLE = 8192            # entries the centroids are fitted on, at most
MAX_CENTROIDS = 256      # of each half
BLOCK = 4096             # entries or queries of a block
SEED = 5


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm; an empty centroid moves to the point that lies
    farthest from its own."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(1)))
        for i, j in enumerate(np.flatnonzero(n == 0)):
            c[j] = x[far[i % len(x)]]
    return c


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1, keepdims=True) + (c * c).sum(1) - 2 * x @ c.T


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, probe: int, cells: int) -> list[int]:
    """Cells with entries, nearest centroid pair first, until they hold
    ``probe`` entries and are ``cells`` in number."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    k, s1, s2 = len(d1), d1[o1].tolist(), d2[o2].tolist()
    heap, seen, out, n = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], 0
    while heap and (n < probe or len(out) < cells):
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k + int(o2[j])
        if held[cell]:
            out.append(cell)
            n += int(held[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < k and b < k and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def needed(u: np.ndarray, cells: list[list[int]], c1: np.ndarray, c2: np.ndarray, held: np.ndarray,
           half: int, recall: float = RECALL) -> int:
    """The least ``probe`` at which the walks of the unit vectors ``u`` pass
    ``recall`` of the cells given for each of them."""
    before: list[int] = []
    for d1, d2, own in zip(_distances(u[:, :half], c1), _distances(u[:, half:], c2), cells):
        order = np.argsort((d1[:, None] + d2).ravel(), kind="stable")
        passed = np.empty(len(order), np.int64)
        passed[order] = np.cumsum(held[order]) - held[order]
        before += passed[own].tolist()
    before.sort()
    return before[int(np.ceil(recall * len(before))) - 1] + 1 if before else 0


def exact_cosines(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, every sum taken from left to right."""
    last = lambda x: np.cumsum(x, axis=1)[:, -1]
    return last(e * q) / (np.sqrt(last(e * e)) * np.sqrt(last(q * q)))


def _rerank(dim: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(entries) and len(queries):
            e, q = matrix(entries, "vector"), matrix(queries, "vector")
            ids = entries["ids"].to_pylist()
            # a query looks at the cells it passed alone (all, where none are named)
            cells, at_cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            passed = np.stack([np.ones(len(cells), bool) if c is None else np.isin(cells, c) for c in queries["cells"].to_pylist()])
            rough = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ (e / np.sqrt((e * e).sum(1, keepdims=True))).T
            rough = np.where(passed[:, at_cell], rough, -np.inf)
            # k entries beside the query's own; all within rounding of the last
            top = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(e) > k + 1 else np.full(len(q), -np.inf)
            row, at = np.nonzero((rough >= top[:, None] - 1e-9) & (rough > -np.inf))
            exact = np.concatenate([exact_cosines(e[at[i:i + BLOCK]], q[row[i:i + BLOCK]]) for i in range(0, max(1, len(at)), BLOCK)])
            ends = np.searchsorted(row, np.arange(len(q) + 1)).tolist()
            exact, at = exact.tolist(), at.tolist()
            for query, a, b in zip(queries["query_id"].to_pylist(), ends, ends[1:]):
                found = [(-exact[i], v) for i in range(a, b) for v in ids[at[i]] if v != query]
                out += [(query, v, -s) for s, v in heapq.nsmallest(k, found)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), schema)],
                                    schema=schema)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding",
           probe: int = PROBE, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return none
    dim = dims["dim"]
    half = (dim + 1) // 2
    rows = rows.where(F.size("vector") == dim)
    # of equal vectors the k + 1 smallest ids (the limit holds before the shuffle)
    nth = Window.partitionBy("vector").orderBy("id")
    entries = pin(rows.select("id", "vector").distinct().withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k + 1)
                  .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))

    n = entries.count()
    some = (entries.select("vector").orderBy(F.xxhash64("vector")).limit(sample).toArrow()["vector"].combine_chunks())
    x = _units(some, dim)
    c = int(np.clip(round(n ** 0.5 / 8), 1, min(MAX_CENTROIDS, max(1, len(x) // 8))))
    c1, c2 = kmeans(x[:, :half], c), kmeans(x[:, half:], c) if dim > half else np.zeros((c, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _units(b.column("vector"), dim)
            cell = _distances(u[:, :half], c1).argmin(1) * c + _distances(u[:, half:], c2).argmin(1)
            yield b.append_column("cell", pa.array(cell.astype(np.int64)))

    kind = vectors.schema[vector].dataType.simpleString()
    index = pin(entries.mapInArrow(assign, f"vector {kind}, ids array<bigint>, cell long"))
    held = np.zeros(c * c, np.int64)
    for r in index.groupBy("cell").count().collect():       # at most c * c rows
        held[r["cell"]] = r["count"]

    queries = rows.where("is_query").select(F.col("id").alias("query_id"), "vector").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(index: DataFrame, asked: DataFrame) -> DataFrame:
        """The ``k`` nearest entries in the cells asked for.  Neighbouring
        cells of about a block together are an area, one task's work."""
        blocks = lambda t, name: t.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias(name))
        per_area = F.broadcast(pin(blocks(index, "n_e").join(blocks(asked, "n_q"), "area")))    # at most c * c rows
        e = (index.join(per_area, "area")
             .withColumn("e", F.pmod(F.xxhash64("vector"), F.col("n_e")))
             .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1))).drop("n_e", "n_q"))
        q = (asked.join(per_area, "area")
             .withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("n_q")))
             .withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_e") - 1))).drop("n_e", "n_q"))
        on = ["area", "e", "q"]
        near = (e.groupBy(*on).cogroup(q.groupBy(*on))
                .applyInArrow(_rerank(dim, k), "query_id long, vec_id long, score double"))
        return (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    # cells in the order of their numbers, cut at about a block of entries
    area = (np.cumsum(held) - held) // BLOCK
    parts = spark.createDataFrame([(int(i), int(area[i])) for i in np.flatnonzero(held)], "cell long, area long")
    index = index.join(F.broadcast(parts), "cell")          # at most c * c rows
    whole = lambda t: t.withColumn("area", F.lit(0).cast("long"))
    some = pin(queries.orderBy(F.xxhash64("query_id", "vector")).limit(CALIBRATE))
    real = pin(nearest(whole(index), whole(some).withColumn("cells", F.lit(None).cast("array<long>"))))    # at most k rows a query
    where = index.select(F.explode("ids").alias("vec_id"), "cell").join(F.broadcast(real), "vec_id")
    cells_of: dict[int, list[int]] = {}
    for r in where.select("query_id", "cell").collect():
        cells_of.setdefault(r["query_id"], []).append(r["cell"])
    asked = some.toArrow()
    if len(asked):
        u = _units(asked["vector"].combine_chunks(), dim)
        probe = max(probe, needed(u, [cells_of.get(i, []) for i in asked["query_id"].to_pylist()], c1, c2, held, half))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _units(b.column("vector"), dim)
            d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
            who, where, what = [], [], []
            for i in range(len(u)):
                passed: dict[int, list[int]] = {}
                for x in walk(d1[i], d2[i], held, probe, cells):
                    passed.setdefault(int(area[x]), []).append(x)
                who += [i] * len(passed)
                where += passed
                what += passed.values()
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("query_id").take(at), b.column("vector").take(at), pa.array(where, pa.int64()),
                 pa.array(what, pa.list_(pa.int64()))], ["query_id", "vector", "area", "cells"])

    return nearest(index, pin(queries.mapInArrow(probes, f"query_id long, vector {kind}, area long, cells array<long>")))


def oracle_sql(every: int = 50, k: int = K) -> str:
    """Brute force in DuckDB; the search finds the same where its walks pass
    all the neighbours' cells (at least ``PROBE`` entries, so those of a small table)."""
    norm = "sqrt(list_dot_product({0}, {0}))"
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / ({norm.format('c.e')} * {norm.format('q.e')}) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {k}"""
