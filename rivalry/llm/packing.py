"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id.  Documents longer than the
capacity are cut into pieces of the capacity; every other piece is packed
whole.  Large-item matching: pieces above one third of the capacity stand at
most two to a sequence, matched greedily - from the longest down, each with
the longest that still fits beside it; then the smaller pieces, from the
longest down, go where they fit best, and open a sequence only where none has
room.

The pieces (numbers only, no texts) are dealt by a hash of their place in the
written table of pieces into groups of about ``group_pieces``, equal rows like
any others; each group is packed by itself, which costs at most a few
sequences that are not full per group of tens of thousands.

Cases: a NULL text is empty and is one piece holding the end id; NULL or
repeated ids are packed like any row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id",
           vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path, tail, step = vocabulary_path(vocabulary), end_id.to_bytes(4, "little"), 4 * capacity
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(body.as_py()) + tail
                for i, a in enumerate(range(0, len(ids), step)):
                    part = ids[a:a + step]
                    out.append((doc, i, a // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)],
                                                 schema=schema)
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, PIECES)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item of a group, given in any order."""
    order = np.argsort(-lengths, kind="stable")
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_large = int((3 * lengths > capacity).sum())
    large, rest = order[:n_large].tolist(), order[n_large:].tolist()
    size = lengths.tolist()

    shelves: list[list[int]] = [[] for _ in range(capacity + 1)]   # by length or by gap
    there = 0                                                      # bit i: shelf i is not empty

    def put(shelf: int, item: int) -> None:
        nonlocal there
        shelves[shelf].append(item)
        there |= 1 << shelf

    def take(shelf: int) -> int:
        nonlocal there
        item = shelves[shelf].pop()
        if not shelves[shelf]:
            there &= ~(1 << shelf)
        return item

    # greedy matching of the large items: longest first, each with the longest that fits
    for item in reversed(large):
        put(size[item], item)
    gaps, opened = [], 0
    while there:
        first = take(there.bit_length() - 1)
        gap = capacity - size[first]
        bins[first] = opened
        fits = there & ((1 << (gap + 1)) - 1)
        if fits:
            second = take(fits.bit_length() - 1)
            bins[second], offsets[second] = opened, size[first]
            gap -= size[second]
        gaps.append(gap)
        opened += 1
    # the gaps, then best fit of the smaller items: the tightest gap that holds it
    for b, gap in enumerate(gaps):
        if gap:
            put(gap, b)
    for item in rest:
        length = size[item]
        fits = there >> length
        if fits:
            gap = length + (fits & -fits).bit_length() - 1
            b = take(gap)
        else:
            gap, b, opened = capacity, opened, opened + 1
        bins[item], offsets[item] = b, capacity - gap
        if gap > length:
            put(gap - length, b)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id",
         vocabulary: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its place: ``PIECES`` plus ``sequence_id`` and ``offset``."""
    made = pin(pieces(docs, capacity, end_id, text, key, vocabulary))
    groups = max(1, round(made.count() / group_pieces))

    def place(group: pa.Table) -> pa.Table:
        g = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack_lengths(g["length"].to_numpy(), capacity)
        bins += g["_group"].to_numpy() << 32
        return g.drop_columns("_group").append_column("sequence_id", pa.array(bins)).append_column(
            "offset", pa.array(offsets))

    dealt = made.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(place, PIECES + ", sequence_id long, offset long")
