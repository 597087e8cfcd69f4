"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (histogram_top_k, language_id, mixing, ngram_join, periodic_runs, pii, sentence_pieces, spelling_variants,
               token_files, toxicity, vp_tree, warc, weighted_sampling)
from .common import table
from .sql import SQL

TOKENIZERS = "/opt/tokenizers"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    path = warc.write_warc(warc.plan_records(pages))
    return warc.read_warc(spark, path, payloads=False).where("fault is null").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_packed_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    with open(f"{tokenizers}/word_bpe_49k.json", encoding="utf-8") as f:
        spec = f.read()
    path = token_files.write_shards(table(spark, sf_dir, "documents"), spec, end_id=2)
    return token_files.digests(spark, path)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model = sentence_pieces.read_model(f"{tokenizers}/piece_bpe_32k.model")
    return sentence_pieces.round_trips(table(spark, sf_dir, "documents"), model)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    w = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), w).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_mix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs)).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.edited_words(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_warc, op3_pii, op4_packed_ids, op5_sentence_pieces, op6_toxicity, op7_fingerprints, op8_mix_plan, op9_nearest, op10_language_id,
                              op11_spelling_variants, op12_periodic_runs, op13_exact_top_k)}
ORACLE_SQL: dict[str, str] = SQL
