"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has eight positional bytes.  Two that differ in at most
``bits`` = 4 bits differ in at most four bytes, so they share at least four
positional bytes, and at least three of the first seven.  The index therefore
has one posting for every three (position, byte) terms among the first seven
positions (35 a fingerprint); within a posting the shared positional bytes of
a pair are tallied over all eight, pairs that reach the guaranteed minimum are
retained, and these are verified by their differing bits.

Only distinct fingerprints are indexed (equal ones are one class), and a
posting gives no list of pairs: its linked members are walked breadth first,
each step comparing one member with those not yet reached, and every member
is tied to the one that reached it.  So a posting of a thousand close copies
gives a thousand links, none of them lost for the components.

Cases: a NULL text or one without words has fingerprint zero and is linked
like any other; a text of fewer words than a shingle is one shingle; NULL
ids take part, but name a component only if it has no other; repeated rows
share a class; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, pin, small, unpacked
from .components import components

SHINGLE = 4
BITS = 4
SEED = 42
POSTING = 1 << 14        # members of a posting that is not split
SLICE = 1 << 15          # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words between ASCII white
    space, shingles of ``shingle`` words joined by spaces, their XXH64."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - k + 1].tolist()
    stops = (ends[k - 1:] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    n, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        h = np.array([h64(body[a:b], SEED) for a, b in zip(starts[i:i + SLICE], stops[i:i + SLICE])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus ``_fp``, the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).astype(np.int64))
    return docs.withColumn("_fp", simhash(F.col(text)))


def linked(members: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one posting (distinct uint64) into the
    classes of its pairs at most ``bits`` apart: (reached, by)."""
    left = members
    to, by = [], []
    queue: list[int] = []
    while len(left):
        if queue:
            at = np.uint64(queue.pop())
        else:
            at, left = left[0], left[1:]
        if not len(left):
            break
        apart = left ^ at
        # tally of shared positional bytes, then the differing bits of what is retained
        same = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = same >= 8 - bits
        near[near] = np.bitwise_count(apart[near]) <= bits
        if near.any():
            got = left[near]
            to.append(got)
            by.append(np.full(len(got), at, np.uint64))
            queue.extend(got.tolist())
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(to), np.concatenate(by)) if to else (none, none)


def _links(bits: int):
    """Runs of equal postings in batches sorted by posting -> links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close():
            if held_key is not None and sum(map(len, held)) > 1:
                to, by = linked(np.concatenate(held).view(np.uint64), bits)
                if len(to):
                    yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(by.view(np.int64))],
                                                     schema=schema)

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            first, last = key[0], key[-1]
            if first != held_key:
                yield from close()
                held_key, held = first, []
            held.append(fp[:cuts[1]])
            if len(cuts) > 2:
                yield from close()
                for a, b in zip(cuts[1:-2], cuts[2:-1]):
                    if b - a > 1:
                        to, by = linked(fp[a:b].view(np.uint64), bits)
                        if len(to):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(to.view(np.int64)), pa.array(by.view(np.int64))], schema=schema)
                held_key, held = last, [fp[cuts[-2]:]]
        yield from close()
    return run


def links(fps: DataFrame, bits: int = BITS, posting: int = POSTING) -> DataFrame:
    """Distinct fingerprints (``_fp``) -> links (a, b) with the classes of all
    pairs at most ``bits`` bits apart.  Postings of more than ``posting``
    members are split."""
    if not 0 <= bits <= 4:
        raise ValueError("the three-byte postings guarantee up to four differing bits")
    byte = lambda p: F.shiftrightunsigned(F.col("_fp"), 8 * p).bitwiseAND(F.lit(255).cast("long"))
    terms = [F.col(f"_b{p}") for p in range(7)]
    keys = [F.lit(i << 24) + F.shiftleft(terms[a], 16) + F.shiftleft(terms[b], 8) + terms[c]
            for i, (a, b, c) in enumerate(combinations(range(7), 3))]
    posts = (fps.select("_fp", *[byte(p).alias(f"_b{p}") for p in range(7)])
             .select(F.explode(F.array(*[k.cast("long") for k in keys])).alias("_post"), "_fp"))
    # a pair within four bits shares a fourth byte too: a long posting becomes
    # five, by the byte at each position it is not keyed by
    long_ = pin(posts.groupBy("_post").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > posting).select("_post"))
    if not long_.isEmpty():
        hot = small(long_.withColumn("_hot", F.lit(True)))
        trio = list(combinations(range(7), 3))
        others = [F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in trio]
        bytes_ = F.array(*[byte(p) for p in range(8)])

        def sub(p):                     # equal hashes by chance only compare some more members
            return F.xxhash64("_post", p, F.get(bytes_, p))
        places = F.get(F.array(*others), F.shiftright("_post", 24).cast("int"))
        posts = (posts.join(hot, "_post", "left")
                 .select(F.explode(F.when(F.col("_hot"), F.transform(places, sub)).otherwise(F.array("_post"))).alias("_post"), "_fp"))
    return (posts.repartition("_post").sortWithinPartitions("_post")
            .mapInArrow(_links(bits), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    bits: int = BITS, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``, written once beside the
    fingerprints) plus ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest key in reach, itself included) and ``component_fp``, the name of
    the class among fingerprints."""
    own = docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep])
    d = packed(docs, _id=F.col(key), _text=F.col(text))
    if keep is not None:
        at = {c: i for i, c in enumerate(docs.columns)}
        d = d.select(*[F.col(f"_c{at[c]}").alias(f"_k{i}") for i, c in enumerate(keep)], "_id", "_text")
        d = d.select(*[F.col(f"_k{i}").alias(f"_c{i}") for i in range(len(keep))], "_id", "_text")
    d = with_fingerprints(d, "_text", shingle).drop("_text")
    if keep is not None:
        d = pin(d)
    classes = pin(d.groupBy("_fp").agg(F.min("_id").alias("least")))
    roots = pin(components(links(classes.select("_fp"), bits)))
    # a class of one fingerprint needs nothing from others; the rest is joined by its root
    named = classes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "least", "root")
    linked_ = named.where("root is not null").unionByName(
        classes.join(roots.select(F.col("root").alias("_fp")).distinct(), "_fp").withColumn("root", F.col("_fp")))
    least = pin(linked_.groupBy("root").agg(F.min("least").alias("component_id")))
    linked_ = pin(linked_.select("_fp", "root").distinct()).join(small(least), "root").select(
        "_fp", F.col("root").alias("component_fp"), "component_id")
    alone = classes.join(linked_.select("_fp"), "_fp", "left_anti").select(
        "_fp", F.col("_fp").alias("component_fp"), F.col("least").alias("component_id"))
    out = d.join(pin(linked_.unionByName(alone)), "_fp")
    return unpacked(out, own.columns, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "component_fp")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
          bits: int = BITS) -> DataFrame:
    """One document of each class: the one with the smallest key (of rows
    with equal keys the smallest row hash; of equal rows one)."""
    whole = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    d = packed(docs, _id=F.col(key), _text=F.col(text), _rank=whole)
    slim = pin(with_fingerprints(d, "_text", shingle).select("_fp", "_rank"))
    classes = pin(slim.groupBy("_fp").agg(F.min("_rank").alias("first")))
    roots = components(links(classes.select("_fp"), bits))
    first = (classes.join(roots, F.col("_fp") == F.col("node"), "left")
             .groupBy(F.coalesce("root", "_fp").alias("class")).agg(F.min("first").alias("_rank")))
    # equal rows among the first ones: dropped by their struct
    kept = d.drop("_id", "_text").join(pin(first.select("_rank")), "_rank", "left_semi")
    return unpacked(kept.dropDuplicates(["_rank"]), docs.columns)
