"""Registered queries, one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, by_value, fim, licenses, mixing, packing, pieces, quality_cnn, quality_rules, ranked, sharding,
               simhash, token_store, warc)
from .common import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    by_value()
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_draws")).alias("taken"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "fingerprint", "component_id")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    sharded = sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sharding.write_shards(sharded, folder)
    placed = sharding.read_shards(spark, folder, sharded.schema)
    return placed.select("doc_id", sharding.row_size().alias("size"), sharding.text_crc32().alias("text_crc32"),
                         F.lit(sharding.LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs, net).select("doc_id", quality_cnn.held_out().alias("held_out"), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.NOTICES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, plan, shards = token_store.write_store(docs)
    return token_store.read_store(docs.select(F.col("doc_id").alias("key")), folder, plan, shards)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.derive(warc.responses(table(spark, sf_dir, "pages"))))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restore(F.col("fim_text"), F.col("fim_form"))
    return made.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                       F.col("fim_prefix").alias("prefix_chars"), F.col("fim_middle").alias("middle_chars"),
                       F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_simhash_dedup, op4_shards, op5_quality_cnn,
                            op6_license_scan, op7_packing, op8_token_store, op9_warc_derivatives, op10_multi_index,
                            op11_pieces, op12_ranked_search, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op2_source_mix": mixing.oracle_sql(),
    "op6_license_scan": licenses.oracle_sql(licenses.NOTICES),
    "op10_multi_index": ann.oracle_sql(),
    "op12_ranked_search": ranked.oracle_sql(),
    "op13_fill_in_middle": fim.oracle_sql(),
}
