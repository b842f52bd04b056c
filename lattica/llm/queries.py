"""Thin queries over whole tables: each applies one operator with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, lexical, licenses, lines, manifest, mixing, nearest, ngram, packing, sharding, simhash, urls
from .common import table, text_of
from .oracles import ORACLES


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_matrices(table(spark, sf_dir, "documents"))
    crc = lambda c: F.crc32(F.col(c)).alias(f"{c}_crc32")
    return packed.select("block", "first_sequence", "n_rows", crc("ids"), crc("position_ids"), "row_starts", "cu_seqlens", "doc_ids", "starts")


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "symbols", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


def op3_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), 8)
    text = F.encode(text_of("row.text"), "UTF-8")
    return sent.select(F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.vector_pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "line")


def op7_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), 512)


def op12_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.lowered_fifth()).drop("source")


QUERIES = {f.__name__: f for f in (op1_token_matrices, op2_ngram_quality, op3_exact_shards, op4_vector_packing, op5_fair_mix, op6_license_scan, op7_pivot_simhash, op8_line_frequency, op9_tile_search, op10_url_rules, op11_heap_token_counts, op12_bucket_search, op13_merkle_manifest)}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
