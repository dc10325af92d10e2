"""Aggregations: exact medians, harmonic means, min/max, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import FALLBACK_PROB
from ..session import materialize
from .ranking import running_sum


BUCKETS = 1 << 16        # of the groups, to find those with many rows
LARGE_BUCKET = 100_000   # rows of a bucket whose groups are not gathered


def group_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                  chunks: int | None = None) -> DataFrame:
    """Exact median of each column in ``cols`` per ``by`` group, NULLs skipped,
    even counts averaged (pandas ``median``).

    Groups are counted in ``BUCKETS`` by their hash.  Those of a bucket of at
    most ``LARGE_BUCKET`` rows are gathered, one shuffle of the rows as they
    are; the others go :func:`_ranked_medians`' way, so no task gathers a team
    that owns a third of all rows.  ``df`` is read up to three times: fix it
    first.
    """
    by = list(by)
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    large = materialize(rows.groupBy(bucket.alias("_b")).count().where(F.col("count") > LARGE_BUCKET).select("_b"))
    n_large = large.count()
    few = rows if not n_large else rows.join(F.broadcast(large), bucket == F.col("_b"), "left_anti")
    out = few.repartition(*by).groupBy(*by).agg(*[F.median(c).alias(c) for c in cols])
    if not n_large:
        return out
    return out.unionByName(_ranked_medians(rows.join(F.broadcast(large), bucket == F.col("_b"), "left_semi"), by, cols, chunks))


def _ranked_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], chunks: int | None = None) -> DataFrame:
    """The medians by the rank of the values, for groups of any size.

    All columns are stacked into one long frame (group, metric, value), so one
    pass serves every column.  Equal values are counted first (a
    partial-aggregated shuffle, so repeated values never travel one by one);
    running counts come from the two-level :func:`running_sum`, so a team that
    owns a third of all rows is spread over many tasks.  The rows that hold the
    middle positions are then picked per group.
    """
    by = list(by)
    stacked = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v")) for c in cols])))
    hist = stacked.groupBy(*by, "_m", "_v").agg(F.count("_v").alias("_c"))
    ranked = running_sum(hist, [*by, "_m"], ["_v"], "_c", out="_cum", total="_n", chunks=chunks)
    k1 = F.floor((F.col("_n") + 1) / 2)
    k2 = F.floor(F.col("_n") / 2) + 1

    def covers(k):
        return (F.col("_cum") - F.col("_c") < k) & (F.col("_cum") >= k)

    aggs = []
    for c in cols:
        is_c = F.col("_m") == c
        aggs.append(F.max(F.when(is_c & covers(k1), F.col("_v"))).alias(f"_lo_{c}"))
        aggs.append(F.max(F.when(is_c & covers(k2), F.col("_v"))).alias(f"_hi_{c}"))
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(*by, *[((F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2).alias(c) for c in cols])


def harmonic_mean_by(df: DataFrame, key: str, value: str, out: str, default: float = FALLBACK_PROB) -> DataFrame:
    """``(mean(x^-1))^-1`` per ``key`` with NULLs skipped and ``default`` for
    groups without any value.  ``pow(0,-1)`` is +inf and ``pow(inf,-1)`` is 0,
    so a zero in a group gives 0, as in the row-wise original.  Partial
    aggregation makes it skew-safe."""
    hm = F.pow(F.avg(F.pow(F.col(value), F.lit(-1.0))), F.lit(-1.0))
    return df.groupBy(key).agg(F.coalesce(hm, F.lit(default)).alias(out))


def column_min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One aggregate for all columns, stacked to rows (feature, x_min, x_max)."""
    row = df.agg(*[F.min(c).cast("double").alias(f"mn_{i}") for i, c in enumerate(cols)],
                 *[F.max(c).cast("double").alias(f"mx_{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"mn_{i}").alias("x_min"), F.col(f"mx_{i}").alias("x_max"))
        for i, c in enumerate(cols)])))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, non-null count and type per column in one aggregate
    (``DataFrame.info``): (position, column, non_null, dtype, rows)."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{f.name}`")).alias(f"_nn_{i}") for i, f in enumerate(fields)])
    return row.select(F.col("_rows").alias("rows"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.col(f"_nn_{i}").alias("non_null"), F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(fields)])))
