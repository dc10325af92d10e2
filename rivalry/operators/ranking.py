"""Running sums, row numbers and dense indexes that never put a whole group
into one task.

A plain ``Window.partitionBy(g).orderBy(o)`` moves every row of a group to
one task.  Groups here are seasons (a handful of values), teams (one team
may own a third of all rows) or the whole table (AUC, team index), so the
window is done in two levels instead:

1. range-partition the rows by ``(group, order)`` into ``chunks`` slices of
   about equal size and tag each row with its slice id; the tagged copy is
   fixed (:func:`~rivalry.session.stored`) so every later step sees the
   same slices, also after an executor is lost;
2. running sum inside each (slice, group) piece - a window over at most one
   slice;
3. per (group, slice) totals - a tiny table of at most ``groups + chunks``
   rows - give each piece the sum of the earlier slices of its group;
4. join the offsets back on (group, slice).

The order columns must make the order total within a group (add a unique
tie breaker) when row numbers are wanted; for sums of a weight over rows
that are already unique per (group, order) nothing else is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_CHUNK = "_rv_chunk"
_LOCAL = "_rv_local"
_OFF = "_rv_off"
_TOT = "_rv_tot"
_W = "_rv_w"
_KEY = "_rv_key"


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                weight: str | Column | None = None, out: str = "cum",
                total: str | None = None, chunks: int | None = None,
                slice_col: str | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight`` within ``by`` in
    ``order`` (``weight=None`` counts rows, i.e. a row number), and
    optionally ``total`` = the group's grand sum.

    ``chunks`` defaults to ``spark.sql.shuffle.partitions``; each slice should
    fit one task comfortably.  ``slice_col`` keeps the slice id under that
    name (for inspection).
    """
    spark = df.sparkSession
    by = list(by)
    ordc = _order_cols(order)
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    base = df.withColumn(_W, w)
    ranged = base.repartitionByRange(n, *[F.col(b) for b in by], *ordc) \
        .withColumn(_CHUNK, F.spark_partition_id())
    ranged = stored(ranged)

    local_w = (Window.partitionBy(_KEY).orderBy(*ordc)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn(_KEY, F.struct(_CHUNK, *by)).withColumn(_LOCAL, F.sum(_W).over(local_w))

    # one row per (group, slice): bounded by groups + slices
    tots = ranged.groupBy(*by, _CHUNK).agg(F.sum(_W).alias(_TOT))
    before = (Window.partitionBy(*by).orderBy(_CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = tots.withColumn(_OFF, F.coalesce(F.sum(_TOT).over(before), F.lit(0)))
    if total:
        whole = Window.partitionBy(*by)
        offs = offs.withColumn(total, F.sum(_TOT).over(whole))
    offs = offs.drop(_TOT)

    # join back on (slice, group) as one key that is never NULL, the window's
    # own partitioning, so the rows are not dealt out again
    offs = offs.select(F.struct(_CHUNK, *by).alias(_KEY), *[c for c in offs.columns if c not in (*by, _CHUNK)])
    joined = local.join(offs, on=_KEY, how="inner").drop(_KEY)
    res = joined.withColumn(out, F.col(_OFF) + F.col(_LOCAL))
    if slice_col:
        res = res.withColumnRenamed(_CHUNK, slice_col)
    return res.drop(_CHUNK, _LOCAL, _OFF, _W)


def row_number(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
               out: str = "rn", total: str | None = None, chunks: int | None = None) -> DataFrame:
    """1-based row number within ``by`` (``order`` must be total)."""
    return running_sum(df, by, order, None, out=out, total=total, chunks=chunks)


def dense_index(df: DataFrame, key: str, out: str = "idx", chunks: int | None = None) -> DataFrame:
    """Map each distinct ``key`` to 0..n-1 in ascending key order.

    The distinct is a partial-aggregated shuffle; the numbering is the
    two-level row number over the whole table, so no single task sees all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return row_number(keys, [], [key], out=out, chunks=chunks) \
        .withColumn(out, (F.col(out) - 1).cast("int"))
