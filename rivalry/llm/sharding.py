"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of the record and its place in the input; pass two shuffles every bucket by Fisher-Yates and writes it out.  The
permuted buckets one after the other are one permutation of the whole table;
it is cut into shards whose row counts differ by at most one (law ``rows``).

The permutation of a bucket is an array of row numbers, made by Spark's own
Fisher-Yates ``shuffle`` with a fixed seed from the bucket's row count alone;
the records are numbered inside their bucket by their hash and look their new
place up.  So records move once, and a lost task repeats the same shuffle:
the small table of permutations lies in a fixed order in fixed partitions and
is written to the shared folder.

Cases: a NULL text has size 16 and checksum 0; NULL or repeated ids are placed
like any row, also where they hold a third of the table (their place parts
them, so the input must read in the same order each time, as files do; write a
shuffled frame first); fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, pin, prefix_sums, unpacked

LAW = "rows"
SHARDS = 40
BUCKET_BYTES = 32 << 20
OVERHEAD = 16            # bytes of a row beside its text
SEED = 7


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")


def shards(docs: DataFrame, n_shards: int = SHARDS, text: str = "text", key: str = "doc_id", seed: int = SEED,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` plus ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless
    from 0 within the shard)."""
    size = docs.agg(F.sum(row_size(text))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.monotonically_increasing_id())
    d = packed(docs, _h=h).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))

    # a few rows per bucket; its partitions and their order are fixed
    counts = pin(d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = prefix_sums(counts, [], "_bucket", "n", "before", total="rows")
    perms = pin(counts.repartition(buckets, "_bucket").sortWithinPartitions("_bucket")
                .select("_bucket", "before", "rows",
                        F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("perm")))

    # the exchange has as many tasks as there are buckets: a task has a few at most
    numbered = d.repartition(buckets, "_bucket").withColumn("_i", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h")) - 1)
    at = (numbered.join(perms, "_bucket", "inner")
          .withColumn("_p", F.col("before") + F.get("perm", F.col("_i"))).drop("perm"))
    at = at.withColumn("shard", F.expr(f"((_p + 1) * {n_shards} - 1) div rows").cast("int"))
    return unpacked(at, docs.columns, "shard", (F.col("_p") - F.expr(f"(shard * rows) div {n_shards}")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder ``shard=<k>`` per shard.  Every bucket's task writes its own
    stretch of slots, in order, to the shards it reaches into, so the records
    are not moved again and no task holds a whole shard."""
    sharded.sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The written rows in the columns of what was written."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*[F.col(f"`{c}`") for c in schema.names])
