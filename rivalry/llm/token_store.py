"""Token-id files with keyed access in constant time.

A store is a folder of shards in ascending key order.  A shard is two files:
``.ids``, the raw ids of its documents one after the other (unsigned,
little-endian, 16 bits where the vocabulary fits and 32 otherwise, each
document with its end id), and ``.mph``, a minimal perfect hash index over its
keys:

    magic ``RVMPH1``, padded to 8 bytes
    u64  bytes of an id, seed, number of keys n, number of levels, bits of every level
    u64  words of the levels' bit maps
    u32  rank: ones before each word
    u32  fingerprint of the key in each slot          (n)
    u64  offset of its ids in the payload, in ids     (n)
    u64  number of ids                                (n)

A key is hashed into the first level whose bit it owns alone; the rank of the
bit is its slot.  The slot's fingerprint tells a stored key from a stranger.
A key is the document id with an occurrence number, so repeated ids are kept.
An id that fills several shards has them for itself (:class:`Plan`): its rows
are dealt to them by their place in the input and numbered in each.

Tasks write under names of their own and report them; the table of shards,
written to the shared folder, names the files that count, so a retried task
does no harm.

Cases: a NULL text is empty and holds the end id alone; a NULL id sorts first
and has keys of its own; an empty table gives an empty store; other columns
are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, prefix_sums, slice_of, small, work_dir
from .tokens import encoder, vocabulary_path

END_ID = 1
SHARD_BYTES = 64 << 20   # text bytes of a shard, about
MAGIC = b"RVMPH1\0\0"
GAMMA = 2.0              # bits of a level for each of its keys

SHARDS = "shard int, n_docs long, n_ids long, name string"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        extra = _mix(occurrence.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64) + np.uint64(seed << 40))
        return _mix(ids.astype(np.int64).view(np.uint64) + extra)


def _level(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Minimal perfect hash over the keys of a shard."""

    def __init__(self, width, seed, sizes, words, rank, prints, offsets, lengths):
        self.width, self.seed, self.sizes, self.words, self.rank = width, seed, sizes, words, rank
        self.prints, self.offsets, self.lengths = prints, offsets, lengths

    @classmethod
    def build(cls, ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, offsets: np.ndarray,
              lengths: np.ndarray, width: int = 4) -> Index:
        seed = 0
        while len(np.unique(h := key_hash(ids, nulls, occurrence, seed))) < len(h):
            seed += 1          # two keys with one hash: another seed parts them
        sizes, maps, left = [], [], h
        while len(left):
            bits = max(64, 64 * math.ceil(GAMMA * len(left) / 64))
            at = _level(left, len(sizes), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[at]]
        words = np.concatenate(maps) if maps else np.zeros(0, "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        rank = (np.cumsum(ones) - ones).astype("<u4")
        index = cls(width, seed, np.array(sizes, "<u8"), words, rank, None, None, None)
        slot = index._slots(h)
        n = len(h)
        index.prints, index.offsets, index.lengths = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
        index.prints[slot], index.offsets[slot], index.lengths[slot] = _fingerprint(h), offsets, lengths
        return index

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of every hash, -1 if no level has a bit for it."""
        slot = np.full(len(h), -1, np.int64)
        open_, base = np.arange(len(h)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            bit = _level(h[open_], level, bits)
            word, at = base + (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            hit = (self.words[word] >> at) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << at) - np.uint64(1)))
            slot[open_[hit]] = (self.rank[word].astype(np.int64) + below)[hit]
            open_, base = open_[~hit], base + bits // 64
            if not len(open_):
                break
        return slot

    def find(self, ids, nulls, occurrence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of every key."""
        h = key_hash(ids, nulls, occurrence, self.seed)
        slot = self._slots(h)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == _fingerprint(h)[found]
        at = np.where(found, slot, 0)
        if not len(self.prints):
            return found, at, at
        return found, self.offsets[at].astype(np.int64), self.lengths[at].astype(np.int64)

    def dump(self) -> bytes:
        head = np.array([self.width, self.seed, len(self.prints), len(self.sizes), *self.sizes.tolist()], "<u8")
        return b"".join([MAGIC, *(x.tobytes() for x in (head, self.words, self.rank, self.prints, self.offsets,
                                                        self.lengths))])

    @classmethod
    def load(cls, data: bytes) -> Index:
        if data[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        width, seed, n, levels = np.frombuffer(data, "<u8", 4, 8).tolist()
        sizes = np.frombuffer(data, "<u8", levels, 40)
        at = 40 + 8 * levels
        parts = []
        n_words = int(sizes.sum()) // 64
        for kind, count in (("<u8", n_words), ("<u4", n_words), ("<u4", n), ("<u8", n), ("<u8", n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(width, seed, sizes, *parts)


class Shard:
    """Keyed access to one shard."""

    def __init__(self, folder: str, name: str):
        files, root = pafs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{root}/{name}.mph") as f:
            self.index = Index.load(f.read())
        self.payload = files.open_input_file(f"{root}/{name}.ids")

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of a document, None for a key that is not stored."""
        null = doc_id is None
        found, offset, length = self.index.find(np.array([0 if null else doc_id]), np.array([null]),
                                                np.array([occurrence]))
        if not found[0]:
            return None
        return self.read(int(offset[0]), int(length[0]))

    def read(self, offset: int, length: int) -> np.ndarray:
        """``length`` ids from ``offset`` on, as unsigned 32-bit numbers."""
        width = self.index.width
        return np.frombuffer(self.payload.read_at(width * length, width * offset), f"<u{width}").astype("<u4")

    def close(self) -> None:
        self.payload.close()


def occurrences(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Occurrence numbers of sorted ids."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - first


def _writer(folder: str, path: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path), np.array([end_id], "<u4").tobytes()
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        shard = name = out = None
        ids: list[int | None] = []
        lengths: list[int] = []

        def close():
            out.close()
            nulls = np.array([i is None for i in ids], bool)
            keys = np.array([i or 0 for i in ids], np.int64)
            n = np.array(lengths, np.int64)
            index = Index.build(keys, nulls, occurrences(keys, nulls), np.cumsum(n) - n, n, width)
            with files.open_output_stream(f"{root}/{name}.mph") as f:
                f.write(index.dump())
            return pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": len(ids), "n_ids": int(n.sum()), "name": name}],
                                              schema=schema)

        for batch in batches:
            for s, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if s != shard:
                    if out:
                        yield close()
                    shard, name, ids, lengths = s, f"{s:06d}-{uuid.uuid4().hex}", [], []
                    out = files.open_output_stream(f"{root}/{name}.ids")
                body = np.frombuffer(encode(text.as_py()) + tail, "<u4")
                out.write(body.astype(f"<u{width}").tobytes())
                ids.append(doc)
                lengths.append(len(body))
        if out:
            yield close()
    return run


@dataclass
class Plan:
    """Which shards hold which ids.  Stretch 0 is the NULL ids, stretch i + 1
    the ids from ``bounds[i - 1]`` up to ``bounds[i]``; a stretch has
    ``parts`` shards, more than one only where it is a single id's."""
    bounds: list[int]
    parts: list[int]

    @property
    def first(self) -> list[int]:
        return [sum(self.parts[:i]) for i in range(len(self.parts))]

    @property
    def shards(self) -> int:
        return sum(self.parts)

    def stretch(self, key: Column) -> Column:
        return F.when(key.isNull(), F.lit(0)).otherwise(slice_of(key, self.bounds) + 1)

    def of(self, values: list[int], stretch: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), stretch)

    def stretch_of_shard(self, shard: Column) -> Column:
        return slice_of(shard.cast("long"), self.first[1:])


def plan_store(docs: DataFrame, text: str, key: str, shard_bytes: int) -> Plan:
    size, k = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16, F.col(key).cast("long")
    total = docs.agg(F.sum(size).alias("n"), F.sum(F.when(k.isNull(), size)).alias("null")).first()
    n, null = max(1, math.ceil((total["n"] or 0) / shard_bytes)), max(1, math.ceil((total["null"] or 0) / shard_bytes))
    marks: list[int] = []
    if n > 1:
        at = F.percentile_approx(k, [i / n for i in range(1, n)], max(10_000, 8 * n))
        marks = sorted(docs.agg(at).first()[0] or [])
    often = {m: marks.count(m) for m in set(marks)} if len(set(marks)) < len(marks) else {}
    hot = {m: c for m, c in often.items() if c > 1}
    bounds = sorted({*marks, *(m + 1 for m in hot if m < (1 << 63) - 1)})
    return Plan(bounds, [null, 1, *[hot.get(b, 1) for b in bounds]])


def write_store(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, text: str = "text",
                key: str = "doc_id", vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES):
    """Write the store; returns (folder, plan, table of shards)."""
    spark = docs.sparkSession
    folder = folder or f"{work_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    plan = plan_store(docs, text, key, shard_bytes)
    stretch = plan.stretch(F.col("key"))
    part = F.pmod(F.xxhash64("_n"), plan.of(plan.parts, stretch))
    d = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_n"))
         .select((plan.of(plan.first, stretch) + part).cast("int").alias("shard"), "key", "text"))
    # by range: a task has one shard or a few neighbours, not those a hash throws together
    table = pin(d.repartitionByRange(plan.shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"))
                .mapInArrow(_writer(folder, vocabulary_path(vocabulary), end_id), SHARDS))
    return folder, plan, table


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            names = batch.column("name").to_pylist()
            keys, occ = batch.column("key"), batch.column("occurrence").to_numpy()
            nulls = keys.is_null().to_numpy(zero_copy_only=False)
            ids = keys.fill_null(0).to_numpy()
            base = batch.column("base").to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != held:
                    if shard:
                        shard.close()
                    held, shard = names[a], Shard(folder, names[a])
                found, offset, length = shard.index.find(ids[a:b], nulls[a:b], occ[a:b])
                if not found.all():
                    raise LookupError(f"{int((~found).sum())} keys are missing from {held}")
                crc = [zlib.crc32(shard.read(o, n)) for o, n in zip(offset.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys[a:b], pa.array(base[a:b] + offset), pa.array(length), pa.array(crc, pa.int64())], schema=schema)
        if shard:
            shard.close()
    return run


def read_store(keys: DataFrame, folder: str, plan: Plan, table: DataFrame) -> DataFrame:
    """Look every key (column ``key``; a repeated one as often) up in the
    files: doc_id, start, n_tokens, ids_crc32."""
    starts = prefix_sums(table, [], "shard", "n_ids", "base").select("shard", "name", "base", "n_docs")
    starts = starts.withColumn("stretch", plan.stretch_of_shard(F.col("shard")))
    starts = prefix_sums(starts, ["stretch"], "shard", "n_docs", "before").select("shard", "name", "base", "n_docs", "before")
    stretch = plan.stretch(F.col("key"))
    first, parts = plan.of(plan.first, stretch), plan.of(plan.parts, stretch)
    k = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
         .select("key", "n", first.alias("first"), parts.alias("parts"))
         .select("key", "n", "parts", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("part", "shard")))
    k = k.join(small(pin(starts)), "shard")
    left = F.col("n") - F.col("before")
    here = F.when(F.col("parts") == 1, F.col("n")).when(F.col("part") == F.col("parts") - 1, left).otherwise(F.least("n_docs", left))
    k = k.withColumn("here", here).where("here > 0").withColumn(
        "occurrence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1)))
    return (k.repartitionByRange(plan.shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"), "occurrence")
            .select("name", "base", "key", "occurrence")
            .mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))
