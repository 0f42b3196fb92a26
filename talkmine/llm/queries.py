"""Queries of the training-data operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine.llm import (
    bpe, brown_lm, conversation_repair, filter_audit, langid, mixing, ngram_join, quality, sharding, topk, toxicity,
    vector_dedup, warc,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trained_on(rows: DataFrame) -> DataFrame:
    """Rows whose labels may be learned from."""
    return rows.filter(langid.fold(F.col("doc_id"), 3) != 1)


def _with_fold(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", langid.fold(F.col("doc_id"), 3) == 1)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_read(spark, sf_dir, "documents"), TOKENIZER)


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _with_fold(langid.identify(docs, langid.learn_from(docs))).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _with_fold(toxicity.score(docs, toxicity.train(docs, trained_on(labels)))).select(
        "doc_id", "held_out", "score", "predicted")


def quality_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    return quality.train(docs, trained_on(labels).filter("quality = 1"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return _with_fold(quality.classify(docs, quality_model(docs, labels))).select(
        "doc_id", "held_out", "score", "predicted")


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(_read(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_mix_sources, op3_bpe, op4_brown_lm, op5_language, op6_toxicity, op7_quality,
        op8_vector_near_dedup, op9_exact_top_k, op10_warc, op11_sharding, op12_filter_audit,
        op13_conversation_repair)}

ORACLES = {"op2_mix_sources": mixing.ORACLE, "op9_exact_top_k": topk.ORACLE, "op10_warc": warc.ORACLE,
           "op12_filter_audit": filter_audit.ORACLE,
           "op13_conversation_repair": conversation_repair.ORACLE}
