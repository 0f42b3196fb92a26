"""A corpus for training: good texts of a known language, one of each near-duplicate group, mixed
to target weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkmine.llm import bpe, langid, mixing, ngram_join, quality
from talkmine.llm.queries import TOKENIZER, quality_model
from talkmine.llm.text import small_batches
from talkmine.session import fresh_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5."""
    small_batches(spark)
    return quality.keep_good(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in one language."""
    small_batches(spark)
    return langid.keep_known(docs, langid.learn_from(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return ngram_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    small_batches(spark)
    return bpe.encoded(docs, TOKENIZER)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: no stage but the mix can be said in SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
