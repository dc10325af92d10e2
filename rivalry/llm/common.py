"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of a table that may be broadcast after they were counted.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a NULL text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset,
    a scratch folder in local mode only (tests, a laptop)."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if sc.getCheckpointDir():
            conf = sc.getCheckpointDir()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            import tempfile
            conf = tempfile.mkdtemp(prefix="rivalry-llm-", dir="/tmp")
        else:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return conf


def pin(df: DataFrame) -> DataFrame:
    """One fixed copy of ``df`` in the shared folder, its lineage cut."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a pinned table of narrow rows) marked for broadcast if it was
    counted to have at most ``rows`` rows; otherwise unmarked, so that it is
    joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body).getItem(0)


def computed(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """``keep`` and the named columns, each computed exactly once a row: a
    filter on them is not moved below (where Spark would compute them again,
    inside a lambda even for every element)."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def prefix_sums(df: DataFrame, keys: Sequence[str], seq: str, value: str, before: str,
                total: str | None = None, span: int = 4096) -> DataFrame:
    """Add ``before`` = sum of ``value`` over smaller ``seq`` within ``keys``
    (``seq`` is a number, unique within ``keys``) and ``total`` = the sum of
    the whole group.

    Two levels: sums inside spans of ``span`` numbers, then over the spans, so
    a task holds ``span`` rows or one row per span.
    """
    keys = list(keys)
    sup = F.floor(F.col(seq) / F.lit(span)).cast("long")
    d = df.withColumn("_span", sup)
    inside = (Window.partitionBy(*keys, "_span").orderBy(seq)
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy(*keys).orderBy("_span")
              .rowsBetween(Window.unboundedPreceding, -1))
    tops = d.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    add = [F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_off")]
    if total:
        add.append(F.sum("_sum").over(Window.partitionBy(*keys)).alias(total))
    tops = tops.select(*keys, "_span", *add)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (d.join(tops, [*keys, "_span"], "inner")
            .withColumn(before, F.col("_in") + F.col("_off")).drop("_span", "_in", "_off"))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``df`` renamed by position (``_c0``, ``_c1``, ...) beside
    the named ones, so that none can clash with an operator's own; columns
    that nothing reads later are still pruned."""
    return df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)],
                     *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: Sequence[str], *columns: str | Column) -> DataFrame:
    """The columns ``names`` of the packed input again, then ``columns``; an
    input column with the name of one of them gives way."""
    new = [F.col(c) if isinstance(c, str) else c for c in columns]
    made = df.select(*new).columns if new else []
    taken = {n.lower() for n in made}
    kept = [(i, c) for i, c in enumerate(names) if c.lower() not in taken]
    # two steps: in one, an input column's name could be taken for what a new
    # column's expression means
    d = df.select(*[F.col(f"_c{i}") for i, _ in kept], *[c.alias(f"_n{j}") for j, c in enumerate(new)])
    return d.select(*[F.col(f"_c{i}").alias(c) for i, c in kept], *[F.col(f"_n{j}").alias(n) for j, n in enumerate(made)])


def slice_of(value: Column, bounds: Sequence[int]) -> Column:
    """Number of the ascending ``bounds`` that are at most ``value`` (0 for
    NULL), by binary search: a pure function of the value, so every stage and
    every retry sees the same slices."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length())])

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(table, mid) <= value)
        left = (acc["lo"] < acc["hi"]) & ~right
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(left, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]
    return F.when(value.isNull(), F.lit(0)).otherwise(found)
