"""The corpus pipeline against a plain version, stage after stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivalry.llm import by_value, mixing, packing, quality_cnn, quality_rules, simhash

from . import data
from .test_simhash import classes
from .test_tokens import ids

by_value()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = data.write(spark, str(tmp_path_factory.mktemp("pipe")))
    rows = [(r[0], int(not 300 <= r[0] < 303)) for r in data.rows() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{f}/labels.parquet")
    return f


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        at[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns

    before, after = at["quality_rules"]
    names, judged = data.duck(folder, quality_rules.oracle_sql())
    kept = [r[names.index("doc_id")] for r in judged if r[names.index("kept")]]
    assert sorted(map(repr, (r.doc_id for r in after))) == sorted(map(repr, kept)) and len(after) > 30

    before, after = at["quality_classifier"]
    net = quality_cnn.train(spark.read.parquet(f"{folder}/documents.parquet"),
                            spark.read.parquet(f"{folder}/labels.parquet"))
    p = quality_cnn.scores(net, [r.text.encode() for r in before])
    assert key(after) == key(r for r, x in zip(before, p) if x >= 0.3)

    before, after = at["simhash_dedup"]
    fps = [simhash.fingerprint(r.text) for r in before]
    cls, first = classes(set(fps)), {}
    for f, r in zip(fps, before):
        first.setdefault(cls[f], set()).add((r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted(min(v) for v in first.values())

    before, after = at["source_mix"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "documents.parquet").symlink_to(tmp_path / "simhash_dedup")
    taken = {r[0]: (r[4], r[1]) for r in data.duck(str(tmp_path / "m"), mixing.oracle_sql())[1]}
    for r in before:
        n, size = taken[r.doc_id]
        assert sum(x.doc_id == r.doc_id for x in after) == n // size

    before, after = at["packing"]
    pieces = []
    for r in before:
        x = ids(r.text) + [packing.END_ID]
        pieces += [(r.doc_id, i, s, len(x[s:s + 2048]), zlib.crc32(np.array(x[s:s + 2048], "<u4").tobytes()))
                   for i, s in enumerate(range(0, len(x), 2048))]
    assert key(r[:5] for r in after) == key(pieces)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run_on_nothing(spark, tmp_path):
    f = data.write(spark, str(tmp_path), [])
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{f}/labels.parquet")
    assert corpus_pipeline.run(spark, f).count() == 0
