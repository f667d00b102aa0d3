"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, decontaminate, html_extract, license_scan, merkle, packing,
               quality_model, quality_rules, simhash, substring_dedup, token_count, url_filter)

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
             ("org/fr/", "allow")]
TOKEN_LIMIT = 2048
QUALITY_CUT = 0.7
MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PROBE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes ``id, bad`` of pages: the number in a page's last path
    step names the document it shows, ``labels`` judges that document."""
    doc = url_filter.with_host(pages).select(
        F.col("page_id").alias("id"),
        F.regexp_extract("path", "/([0-9]+)[^/]*$", 1).try_cast("bigint").alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return doc.join(bad, "doc_id").select("id", "bad")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, _table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(pages, outcomes, URL_RULES).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def packed_digest(docs: DataFrame) -> DataFrame:
    """Packed pieces with the CRC of their ids in place of the ids, which are
    read but never shuffled."""
    pieces = packing.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
        TOKEN_LIMIT).withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"),
                                      _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = F.col("id") == 0
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(first, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return chat_format.digest(chat_format.format_table(turns.unionByName(probe)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh document or so is tampered with before it is checked
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(
        _table(spark, sf_dir, "documents"), MANIFEST_COLUMNS,
        suspect={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    ).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
             F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
             "folded_root", "verified")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = quality_model.train(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return quality_model.score(docs, model).withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op13_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filters, op3_best_fit_packing, op4_token_counts,
    op5_html_extraction, op6_license_scans, op7_simhash_near_dedup,
    op8_benchmark_decontamination, op9_substring_dedup, op10_chat_formatting,
    op11_merkle_manifest, op12_quality_classifier, op13_phrase_collocation_mining)}
