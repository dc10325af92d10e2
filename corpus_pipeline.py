"""Corpus pipeline: quality rules, quality classifier, near-duplicates, source
mix, packing - each stage over everything its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of
``documents`` (the last one: the packed pieces).  :func:`run` writes each
stage's result as Parquet into the shared folder named by
``spark.checkpoint.dir`` and reads it back as the next stage's documents, so a
lost executor costs one stage's tasks at most.  A stage's result goes once the
next one's is written; the last stays.

Documents that a stage rejects go: those that break the quality rules, those
the classifier scores under its threshold, all but one of each group of near
duplicates.  The mix repeats or leaves out documents to meet its weights; the
repeats are packed like any document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rivalry.llm import by_value, mixing, packing, quality_cnn, quality_rules, simhash
from rivalry.llm.common import work_dir


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # learned from the whole labelled table: the rules before it have removed
    # most examples of label 0 from ``docs``
    by_value()
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return quality_cnn.keep(docs, quality_cnn.train(read("documents"), read("labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_value()
    return simhash.dedup(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs).drop("mix_shard")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_value()
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_dedup", simhash_stage),
    ("source_mix", source_mix_stage),
    ("packing", packing_stage),
]

#: A trained network and a hash of shingles are not SQL; the pipeline is
#: tested against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{work_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder this run wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
