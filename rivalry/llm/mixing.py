"""Mixing sources to target weights.

The documents of a source are permuted by a seeded hash and cut into blocks;
a source's target is met by whole passes over its blocks and one partial pass.
A splitting tree deals the block quotas to the output shards: every node draws
the left half's quotas from the multivariate hypergeometric distribution
(source after source, each conditional on those before), down to single shards.
A shard then holds a range of each source's permuted block sequence - ranges of
different shards are disjoint - and its documents are shuffled locally.

A mix has a shard per ``shard_words`` words, at least ``min_shards``, and about
``SHARD_BLOCKS`` blocks a shard, so the tree splits tables of any size.

Everything is DataFrame code.  Data that is joined by broadcast: one row per
source (the weight table of the mix), and the block table if it was counted
to be small.  The quotas of a tree node are one array with a number per
source, so the number of sources must stay that of a weight table; the rows
of a source may be any share of the input.

Cases: a NULL text has size 0; a NULL source is a source of its own, last in
order; documents that agree in ``doc_id`` and size hash alike and are taken
alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, pin, prefix_sums, small, unpacked, words

WEIGHTS = (1, 2, 3)      # repeating, over the sources in code-point order
CAP = 3                  # a source is passed over three times at most
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SHARD_BLOCKS = SHARD_WORDS // BLOCK_WORDS
MIN_SHARDS = 16
MAX_PARTITIONS = 1 << 15   # beyond, a partition holds several shards in a row
SEED = "mix-1"

_HASH_BITS = 60


def order_hash(seed: str, *cols: Column) -> Column:
    """A seeded 60-bit hash, the same in every engine that has md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus ``rank`` (from 0), ``weight``, ``target``.

    Targets are ``weight * level``; a source above ``cap`` times its size is
    held there and the rest is reshared, until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = pin(sources.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w))
    most = F.lit(cap) * F.col("source_size")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    held = F.lit(False)
    n_held = -1
    while True:
        got = s.agg(F.sum(F.when(held, most)).alias("fixed"), F.sum(F.when(~held, F.col("weight"))).alias("w"),
                    F.sum(held.cast("long")).alias("n")).first()
        rest, share = total - (got["fixed"] or 0), got["w"] or 1
        level = F.col("weight") * F.lit(rest).cast("long") / F.lit(share).cast("long")
        if got["n"] == n_held or got["n"] is None:
            break
        n_held = got["n"]
        held = held | (level > most)
    return s.withColumn("target", F.when(held, most.cast("double")).otherwise(level))


def hypergeometric(u: Column, population: Column, good: Column, draws: Column) -> Column:
    """Number of good ones among ``draws`` of ``population``: inverse of the
    distribution function at ``u``, the outcomes taken from the mode upwards,
    then downwards (those beyond 12 standard deviations weigh nothing in
    double precision)."""
    N, K, n = (c.cast("double") for c in (population, good, draws))
    low = F.greatest(F.lit(0.0), n + K - N)
    high = F.least(n, K)

    def at_mode(mode):
        sd = F.sqrt(n * (K / N) * (1 - K / N) * (N - n) / F.greatest(N - 1, F.lit(1.0)))
        reach = F.ceil(12 * sd) + 4
        top, bottom = F.least(high, mode + reach), F.greatest(low, mode - reach)
        up = F.when(top > mode, F.sequence((mode + 1).cast("long"), top.cast("long"))).otherwise(
            F.array().cast("array<bigint>"))
        down = F.when(bottom < mode, F.sequence((mode - 1).cast("long"), bottom.cast("long"), F.lit(-1).cast("long"))
                      ).otherwise(F.array().cast("array<bigint>"))
        rise = lambda k: (K - k + 1) * (n - k + 1) / (k * (N - K - n + k))                    # noqa: E731
        fall = lambda k: (k + 1) * (N - K - n + k + 1) / ((K - k) * (n - k))                  # noqa: E731
        state = lambda w, cum: F.struct(w.alias("w"), cum.alias("cum"))                       # noqa: E731

        def walk(ratio, start):
            return lambda seq: F.aggregate(seq, start, lambda acc, k: let(
                acc["w"] * ratio(k.cast("double")), lambda w: state(w, acc["cum"] + w)))["cum"]

        start = state(F.lit(1.0), F.lit(0.0))
        above, below = walk(rise, start)(up), walk(fall, start)(down)

        def pick(goal):
            def search(ratio, cum0):
                first = F.struct(F.lit(1.0).alias("w"), cum0.alias("cum"), F.lit(None).cast("long").alias("k"))
                step = lambda acc, k: let(
                    acc["w"] * ratio(k.cast("double")),
                    lambda w: F.struct(w.alias("w"), (acc["cum"] + w).alias("cum"),
                                       F.coalesce(acc["k"], F.when(acc["cum"] + w >= goal, k)).alias("k")))
                return lambda seq: F.aggregate(seq, first, step)["k"]
            return (F.when(goal <= 1.0, mode.cast("long"))
                    .otherwise(F.coalesce(search(rise, F.lit(1.0))(up), search(fall, 1.0 + above)(down),
                                          mode.cast("long"))))
        return let(u * (1.0 + above + below), pick)

    mode = F.least(high, F.greatest(low, F.floor((n + 1) * (K + 1) / (N + 2)).cast("double")))
    return F.when((draws <= 0) | (good <= 0), F.lit(0).cast("long")).when(low == high, low.cast("long")).otherwise(
        let(mode, at_mode))


def shard_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """The splitting tree: (rank, quota) -> (rank, shard, quota), the quotas
    of a rank summing to its own and the shards' totals as even as whole
    blocks allow."""
    size = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    node = (quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))),
                                   lambda x: x["quota"].cast("long")).alias("q"))
            .select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q").where(F.size("q") > 0))
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        half = F.floor(size * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        d = node.withColumn("mid", mid).withColumn("n", size).withColumn("half", half)

        def draw(acc, x):
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["out"])),
                        F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return let(hypergeometric(u, acc["n"], x, acc["half"]), lambda y: F.struct(
                (acc["n"] - x).alias("n"), (acc["half"] - y).alias("half"),
                F.concat(acc["out"], F.array(y)).alias("out")))

        first = F.struct(F.col("n").alias("n"), F.col("half").alias("half"),
                         F.array().cast("array<bigint>").alias("out"))
        d = d.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("q", first, draw)["out"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        kids = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "q"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")),
            F.struct(F.col("mid").alias("lo"), "hi", right.alias("q"))))
        node = d.select(F.inline(kids))
        if level % 6 == 5:
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("shard"), F.posexplode("q").alias("rank", "quota"))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``source``) plus ``mix_size``,
    ``mix_source_size``, ``mix_target`` and ``mix_draws``: an array with one
    (epoch, shard) for every time the mix takes the document.  Arguments are
    those of :func:`dealt`."""
    return dealt(docs, *args, **options)[0]


def mixed_corpus(docs: DataFrame, *args, **options) -> DataFrame:
    """The mixed corpus itself (see :func:`shuffled`).  Arguments are those of
    :func:`dealt`."""
    return shuffled(*dealt(docs, *args, **options))


def dealt(docs: DataFrame, text: str = "text", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED,
          block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
          min_shards: int = MIN_SHARDS) -> tuple[DataFrame, int]:
    """The rows of :func:`mix` and the number of shards they are dealt to."""
    base = packed(docs, _id=F.col("doc_id"), _source=F.col("source"), mix_size=F.size(words(F.col(text))).cast("long"))
    base = base.withColumn("_h", order_hash(seed, F.col("_id"), F.col("mix_size")))
    slim = pin(base.groupBy("_source", "_h").agg(F.sum("mix_size").alias("words")))

    src = targets(slim.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, cap)
    total = src.agg(F.sum("source_size")).first()[0] or 0
    shards = max(min_shards, math.ceil(total / shard_words))
    block_words = max(1, min(block_words, math.ceil(total / (shards * SHARD_BLOCKS))))
    src = (src.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                          .otherwise(F.lit(0)).cast("long"))
           .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
           .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")))
    src = pin(src.select("source", "rank", "source_size", "target", "passes", "rest", "n_blocks"))

    def with_source(d: DataFrame, s: DataFrame) -> DataFrame:
        return (d.join(small(s), F.col("_source").eqNullSafe(F.col("source")), "inner").drop("source")
                # 32 bits of the hash, so that the product stays a long
                .withColumn("block", F.shiftright(F.shiftright("_h", _HASH_BITS - 32) * F.col("n_blocks"), 32)))

    hashed = with_source(slim, src)
    sums = hashed.groupBy("rank", "block").agg(F.sum("words").alias("words"))
    # the partial pass of a source ends inside one block: the largest hash
    # that is still taken there
    cut = pin(prefix_sums(sums, ["rank"], "block", "words", "start")
              .join(small(src.select("rank", "rest")), "rank")
              .where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words")))
              .select("rank", F.col("block").alias("cut_block"), "start"))
    inside = Window.partitionBy("rank").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (hashed.join(small(cut), "rank").where(F.col("block") == F.col("cut_block"))
            .withColumn("upto", F.col("start") + F.sum("words").over(inside))
            .where(F.col("upto") - F.col("words") / 2 < F.col("rest"))
            .groupBy("rank").agg(F.max("_h").alias("cut_hash")))
    src = pin(src.join(cut.drop("start"), "rank", "left").join(last, "rank", "left"))

    partial = F.when(F.col("cut_hash").isNull(), F.col("cut_block")).otherwise(F.col("cut_block") + 1)
    quota = src.select("rank", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.coalesce(partial, F.lit(0))).alias("quota"))
    ranges = prefix_sums(shard_quotas(quota, shards, seed), ["rank"], "shard", "quota", "first").where("quota > 0")
    draws = (ranges.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("d"))
             .join(small(quota), "rank")
             .select("rank", "shard", F.expr("d div n_blocks").alias("epoch"), F.expr("d % n_blocks").alias("block"))
             .groupBy("rank", "block")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), "shard"))).alias("draws")))

    d = with_source(base, src).join(small(pin(draws)), ["rank", "block"], "left")
    whole = lambda x: ((x["epoch"] < F.col("passes")) | (F.col("block") < F.col("cut_block"))
                       | ((F.col("block") == F.col("cut_block")) & (F.col("_h") <= F.col("cut_hash"))))
    picked = F.coalesce(F.filter("draws", lambda x: F.coalesce(whole(x), F.lit(False))),
                        F.array().cast("array<struct<epoch:int,shard:int>>"))
    return unpacked(d, docs.columns, "mix_size", F.col("source_size").alias("mix_source_size"),
                    F.col("target").alias("mix_target"), picked.alias("mix_draws")), shards


def shuffled(mixed: DataFrame, shards: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: one row per taken copy with its ``mix_shard``,
    the rows of a shard together and shuffled by a seeded hash.  A partition
    holds one shard, or a run of them beyond ``MAX_PARTITIONS``; where the
    number of ``shards`` is not given, a pass over ``mixed`` finds it."""
    if shards is None:
        last = mixed.agg(F.max(F.array_max("mix_draws.shard"))).first()[0]
        shards = 1 if last is None else last + 1
    parts = min(shards, MAX_PARTITIONS)
    plain = mixed.drop("mix_draws", "mix_size", "mix_source_size", "mix_target")
    d = packed(mixed.select(*plain.columns, "mix_draws"), _id=F.col("doc_id"), _draw=F.explode("mix_draws"))
    d = d.withColumn("mix_shard", F.col("_draw.shard")).withColumn(
        "_k", F.xxhash64(F.lit(seed), "mix_shard", "_draw.epoch", "_id"))
    place = F.floor(F.col("mix_shard").cast("long") * parts / shards).cast("int")
    d = d.repartitionById(parts, place).sortWithinPartitions("mix_shard", "_k")
    return unpacked(d, plain.columns, "mix_shard")


def oracle_sql() -> str:
    """Sizes, targets and takings in DuckDB (which shard a copy goes to is
    not part of them)."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
           FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || CAST(size AS VARCHAR)),
                                    1, 15) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})] AS w FROM s),
sat AS (SELECT *, row_number() OVER (ORDER BY CAST({CAP} * source_size AS DOUBLE) / w, source NULLS LAST) AS k FROM r),
lev AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum({CAP} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
               sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM sat),
fit AS (SELECT rest, share, k FROM lev WHERE CAST(rest AS DOUBLE) * w / share <= {CAP} * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN sat.k < fit.k THEN CAST({CAP} * source_size AS DOUBLE)
             ELSE CAST(w * fit.rest AS DOUBLE) / CAST(fit.share AS DOUBLE) END AS target FROM sat, fit),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
c AS (SELECT source, h, sum(hs) OVER (PARTITION BY source ORDER BY h) - hs / 2.0 AS mid
      FROM (SELECT source, h, sum(size) AS hs FROM h GROUP BY source, h))
SELECT h.doc_id, h.size, p.source_size, p.target,
       CAST(h.size * (passes + CASE WHEN c.mid < target - passes * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source
JOIN c ON c.source IS NOT DISTINCT FROM h.source AND c.h = h.h"""
