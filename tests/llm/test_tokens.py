"""Token ids, packing and the token store against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivalry.llm import by_value, packing, token_store, tokens

from . import data

by_value()
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
AWKWARD = ["Don't I'll we've IT'S 'S 'T", "naïve café ÀÉÎ straße ẞ Ǆ ǅ x²³ ½ 10,000.5 <html>|#", "a b",
           "\x1cfoo\x85bar", "é ö", "İstanbul ıi", "中文 текст", "<|endoftext|> hi <|startoftext|>x",
           "“quoted” — dash…", "x y", "tab\tnew\nline\vv\ff\rr", "", "   ", "ª º ŉ ǰ", "​zero‍", "€5 £3 ¢"]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_ids_equal_the_library():
    e = tokens.Encoder(tokens.vocabulary_path())
    for text in AWKWARD + [r[1] for r in data.rows() if r[1]]:
        assert np.frombuffer(e(text), "<u4").tolist() == ids(text)
    e.words.limit = e.runs.limit = 3           # a full memory starts again
    assert np.frombuffer(e(" ".join(data.WORDS)), "<u4").tolist() == ids(" ".join(data.WORDS))


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths(seed):
    r = np.random.default_rng(seed)
    n = np.concatenate([r.integers(1, 2049, 400), r.integers(1, 90, 900), np.full(50, 2048), [683, 682, 1365, 1366, 1]])
    bins, at = packing.pack_lengths(n)
    order = np.lexsort((at, bins))
    b, a, x = bins[order], at[order], n[order]
    new = np.r_[True, b[1:] != b[:-1]]
    assert (a[new] == 0).all() and (a[~new] == (a + x)[:-1][~new[1:]]).all() and (a + x <= 2048).all()
    large = np.bincount(bins[3 * n > 2048])
    assert large.max() <= 2 and sorted(set(b)) == list(range(b.max() + 1))
    assert b.max() + 1 <= 1.03 * max(n.sum() / 2048, (n > 1024).sum()) + 1
    assert packing.pack_lengths(np.zeros(0, np.int64))[0].size == 0


def test_pack(spark):
    rows = data.rows()
    got = packing.pack(data.table(spark, rows), group_pieces=40).collect()
    expected = []
    for r in rows:
        x = ids(r[1]) + [0]
        expected += [(r[0], i, s, len(x[s:s + 2048]), crc(x[s:s + 2048])) for i, s in enumerate(range(0, len(x), 2048))]
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in key) for r in got), key=repr) == sorted(expected, key=repr)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in held.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= 2048
    assert packing.pack(data.table(spark, [])).count() == 0


def test_store_round_trip(spark, tmp_path):
    rows = data.rows()
    d = data.table(spark, rows)
    folder, plan, shards = token_store.write_store(d, str(tmp_path / "store"), shard_bytes=20_000)
    got = token_store.read_store(d.select(F.col("doc_id").alias("key")), folder, plan, shards).collect()
    assert plan.shards >= 3 and shards.count() >= 3
    # ascending ids, NULL first; equal ids in any order among themselves
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(ids(r[1]) + [1])
    start = 0
    for i in sorted(by_id, key=lambda i: (i is not None, i or 0)):
        own = sorted((r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i)
        assert sorted((n, c) for _, n, c in own) == sorted((len(x), crc(x)) for x in by_id[i])
        for s, n, _ in own:
            assert s == start
            start += n
    # keyed access to a single document, and a stranger
    names = [r.name for r in shards.collect()]
    found = [x for x in (token_store.Shard(folder, n).get(303) for n in names) if x is not None]
    assert len(found) == 1 and found[0].tolist() == by_id[303][0]
    assert all(token_store.Shard(folder, n).get(987_654_321) is None for n in names)
    with pytest.raises(Exception, match="keys are missing"):
        token_store.read_store(spark.createDataFrame([(299,)], "key long"), folder, plan, shards).collect()


def test_store_of_nothing(spark, tmp_path):
    d = data.table(spark, [])
    folder, plan, shards = token_store.write_store(d, str(tmp_path / "empty"))
    assert token_store.read_store(d.select(F.col("doc_id").alias("key")), folder, plan, shards).count() == 0


@pytest.mark.parametrize("n", (0, 1, 2, 1000))
def test_perfect_hash_is_minimal(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(-2**62, 2**62, n))
    zero = np.zeros(len(keys), np.int64)
    index = token_store.Index.load(token_store.Index.build(keys, zero > 0, zero, keys * 0 + np.arange(len(keys)), zero + 7, 2).dump())
    h = token_store.key_hash(keys, zero > 0, zero, index.seed)
    assert sorted(index._slots(h).tolist()) == list(range(len(keys))) and index.width == 2
    found, offset, length = index.find(keys, zero > 0, zero)
    assert found.all() and offset.tolist() == list(range(len(keys))) and (length == 7).all()
    if len(keys):
        other, _, _ = index.find(keys + 1, zero > 0, zero)
        assert not other.any()


def hot_rows(key=5, n=300, others=500):
    return [(key, f"same words {data.WORDS[0]} " * 20)] * n + [(1000 + i, f"{data.WORDS[i % 30]} " * (5 + i % 30)) for i in range(others)]


@pytest.mark.parametrize("key", (5, None, 1100, 5000))
def test_store_splits_a_key_with_a_third_of_the_rows(spark, tmp_path, key):
    rows = hot_rows(key)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    d = spark.createDataFrame(d.collect(), d.schema)               # reads in the same order each time
    folder, plan, shards = token_store.write_store(d, str(tmp_path / "store"), shard_bytes=8_000)
    held = {r.shard: r.n_docs for r in shards.collect()}
    assert max(held.values()) < len(rows) / 5 and max(plan.parts) > 3
    got = token_store.read_store(d.select(F.col("doc_id").alias("key")), folder, plan, shards).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (repr(i), len(ids(t)) + 1, crc(ids(t) + [1])) for i, t in rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):                   # ascending ids, gapless
        assert r.start == start
        start += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_pack_spreads_equal_rows(spark):
    rows = hot_rows(n=400, others=600)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group_pieces=100)
    size = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(size) > 5 and max(size) < 200 and sum(size) == got.count()
