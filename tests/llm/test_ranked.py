"""Ranked search against a brute-force version and SQL."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalry.llm import by_value, queries, ranked

from . import data

by_value()
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    docs = [(i, words(t)) for i, t in docs]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in docs:
            m = 25 + (75 * len(t) * n) // total
            s = 0
            for w in words(text):
                tf = t.count(w)
                if tf:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The river, the STONE and the winter light!"), (1, "garden paper"), (None, "valley market bridge"), (3, None),
         (4, ""), (5, "nothing-here zzz"), (6, "héllo straße 中文 TEXT"), (7, "the " * 30 + "harbour"), (8, "x x x"), (8, "x x x"),
         (9, "end of it we shout loud one finally")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "item_id long, text string, score string, rank int")


def test_terms():
    for r in data.rows():
        assert [w.decode() for w in ranked.terms((r[1] or "").encode())] == words(r[1])


@pytest.mark.parametrize("block,group", [(2_000_000, 4 << 20), (60, 40)])
def test_search(spark, monkeypatch, block, group):
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ranked.search(data.table(spark), items(spark), query_bytes=group)
        got = sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute([(r[0], r[1]) for r in data.rows()], ITEMS)


def test_sql(spark, tmp_path):
    folder = data.write(spark, str(tmp_path))
    items(spark).write.parquet(f"{folder}/benchmark.parquet")
    data.same(queries.op12_ranked_search(spark, folder),
              data.duck(folder, ranked.oracle_sql(), ("documents", "benchmark")))


def test_empty_tables(spark):
    d, i = data.table(spark), items(spark)
    assert ranked.search(d.limit(0), i).count() == 0
    assert ranked.search(d, i.limit(0)).count() == 0
    assert ranked.search(d.withColumn("text", F.lit(None).cast("string")), i).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_accumulators_are_limited_and_scores_exact(seed):
    """A block's answer equals scoring every document, with fewer accumulators."""
    r = np.random.default_rng(seed)
    n_terms, n_docs = 30, 3000
    share = np.concatenate((np.full(10, 0.01), np.full(10, 0.1), np.full(10, 0.9)))
    there = r.random((n_docs, n_terms)) < share
    doc, term = np.nonzero(there)
    tf, n = r.integers(1, 5, len(doc)), r.integers(20, 200, n_docs)
    block = ranked.Block(n, np.bincount(doc, minlength=n_docs), term, tf, n_terms, n_docs, int(n.sum()))
    df = there.sum(0)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df]
    for _ in range(5):
        q = [(int(t), weight[t] * int(r.integers(1, 3))) for t in r.choice(n_terms, 12, replace=False)]
        q.sort(key=lambda x: df[x[0]])
        full = np.zeros(n_docs, np.int64)
        m = 25 + 75 * n * n_docs // n.sum()
        for t, w in q:
            at = doc[term == t]
            f = tf[term == t]
            full[at] += w * (10 ** 9 * f // (1000 * f + 8 * m[at]))
        at, score = block.best(q, 10)
        least = np.sort(full)[-10]
        assert sorted(zip(at, score)) == [(i, full[i]) for i in np.flatnonzero(full >= max(least, 1))]
    assert block.created < n_docs
