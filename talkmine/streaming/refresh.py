"""Incremental refresh of all tables from arriving episodes, by Structured Streaming.

Every table adds the episodes it does not hold yet, so a replayed batch, or one cut short
between two tables, ends in the same state as a clean run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine.functions.text import tokens
from talkmine.operators.chunking import chunk_payload
from talkmine.operators.enrichment import postings
from talkmine.session import stored
from talkmine.sources.sinks import append_new, first_per_key, read_table, upsert_new, without_held

TERM_BUCKETS = 64


def refresh(payload: DataFrame, tables: str) -> None:
    """One batch of landing rows into the channel, episode, chunk and index tables.

    Chunks are made once and stored, since what is added to each table is found and taken from them.
    """
    payload = first_per_key(payload, "video_id")
    known = read_table(payload.sparkSession, f"{tables}/channels")
    channels = payload.select("channel_id", "channel_name", "genre")
    upsert_new(known, channels, "channel_id").write.mode("append").parquet(f"{tables}/channels")
    append_new(payload, f"{tables}/episodes", "video_id")
    chunks = stored(chunk_payload(payload))
    append_new(chunks, f"{tables}/chunks", "video_id")
    maintain_postings(chunks, tables)


def maintain_postings(chunks: DataFrame, tables: str) -> None:
    """Add new chunks to the keyword index.

    ``doc_lengths`` is written last and says which chunks are indexed. The rows of a chunk
    whose lengths are missing are written again under the same key and read once.
    """
    held = read_table(chunks.sparkSession, f"{tables}/doc_lengths")
    todo = chunks if held is None else without_held(chunks, held, "chunk_id")
    if todo is None:
        return
    rows = postings(todo).withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))
    rows.repartition("term_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.mode("append").partitionBy(
        "term_bucket").parquet(f"{tables}/postings")
    lengths = todo.select("chunk_id", F.size(tokens(F.col("chunk_text"))).cast("long").alias("doc_len"))
    lengths.write.mode("append").parquet(f"{tables}/doc_lengths")


def read_index(spark: SparkSession, tables: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Posting rows of ``terms``, reading their buckets only, and the corpus figures."""
    wanted = [F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_BUCKETS)).cast("int") for t in terms]
    rows = spark.read.parquet(f"{tables}/postings").filter(
        F.col("term_bucket").isin(*wanted) & F.col("term").isin(terms))
    lengths = spark.read.parquet(f"{tables}/doc_lengths").dropDuplicates(["chunk_id"])
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("doc_len").alias("avg_len"))
    return rows.drop("term_bucket").dropDuplicates(["term", "chunk_id"]), stats


def dedupe_stream(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated keys that arrive within ``delay`` of each other; state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Append the rows of a stream whose key the table doesn't hold, however late they come.

    Unlike a watermark, this drops no late row, and its memory is the table itself.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_new(first_per_key(batch, key), path, key)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_refresh(
    source: DataFrame, tables: str, checkpoint: str, to_payload: Callable[[DataFrame], DataFrame] = lambda df: df
) -> None:
    """Process everything that has arrived since the last run, then stop."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(to_payload(batch), tables)

    source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
