"""Fill-in-middle and its rank index."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivalry.llm import by_value, fim, queries

from . import data

by_value()


def brute(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", n, None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", n, a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", n, a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = data.rows() + [(i, t, "en", "s", None, *["x"] * len(data.CLASH)) for i, t in enumerate(
    ["a <P> b", "x<S>", "<M>", "<", "<P", "a<P<S", "é" * 700, "中é🙂a\n" * 3000, "a" * 200_000 + "中" * 200_000, "z"] * 4, 1000)]


def test_transform(spark):
    made = fim.transform(data.table(spark, ROWS))
    got = made.withColumn("back", fim.restore(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["fim_form"], r["fim_units"], r["fim_prefix"], r["fim_middle"], r["fim_text"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert made.columns == data.SCHEMA.names + ["fim_form", "fim_units", "fim_prefix", "fim_middle", "fim_text"]


def test_sql(spark, tmp_path):
    folder = data.write(spark, str(tmp_path), ROWS)
    data.same(queries.op13_fill_in_middle(spark, folder), data.duck(folder, fim.oracle_sql()))


def test_other_settings(spark):
    d = spark.createDataFrame([(i, "one\ntwo\n\nthree 中\nfour", "x") for i in range(40)], "doc_id long, text string, fim_text string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = fim.transform(d, unit="line", sentinels=marks, salt="x", plain_from=100, spm_below=50)
    for r in made.withColumn("back", fim.restore(F.col("fim_text"), F.col("fim_form"), marks)).collect():
        assert r["fim_units"] == 5 and r["back"] == r["text"] and r["fim_form"] != "plain"
        middle = r["fim_text"].split("[mid]")[1]
        assert middle == "" or middle.endswith("\n") or r["text"].endswith(middle)
    assert fim.transform(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(d, sentinels=("<P>", "<P>x", "<M>"))
    with pytest.raises(ValueError):
        fim.boundaries(np.zeros(1, np.uint8), "page")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=600), st.sampled_from([0, 1, 7, 120]))
def test_rank_index(steps, error):
    offsets = np.cumsum(steps).astype(np.int32)
    index = fim.RankIndex(offsets, error)
    ranks = np.arange(len(offsets))
    assert index.at(ranks) == offsets.tolist()
    assert np.abs(offsets - index.predict(ranks)).max() <= error + 1


def test_few_segments():
    plain = fim.RankIndex(fim.boundaries(np.frombuffer(b"a" * 1_000_000, np.uint8)))
    assert len(plain.first) == 1 and not plain.residual.any()
    mixed = fim.RankIndex(fim.boundaries(np.frombuffer(("abc 中" * 100_000).encode(), np.uint8)))
    assert len(mixed.first) == 1 and mixed.residual.any()
    two = fim.RankIndex(fim.boundaries(np.frombuffer(("a" * 50_000 + "中" * 50_000).encode(), np.uint8)))
    assert len(two.first) == 2


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_boundaries(text):
    expected = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
    assert fim.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == expected
