"""The given tables recast as episodes, segments, claims and so on.

A document is an episode and each of its lines a segment; orders become claims, customers
become episode titles, events the search log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.text import watch_url
from talkmine.operators.metrics import stamp, with_load_metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a small file that would be read by one task.

    Large inputs have more splits than cores and are left where they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _metadata_columns() -> list[Column]:
    video, minutes = F.col("doc_id").cast("string"), 20 + (F.col("doc_id") * 13) % 200
    views = F.col("n_chars") * (F.col("doc_id") % 97 + 1)
    published = F.date_add(F.lit("2022-01-01").cast("date"), ((F.col("doc_id") * 37) % 1400).cast("int"))
    return [
        video.alias("video_id"), F.concat(F.lit("Episode "), video).alias("title"),
        F.concat(F.lit("UC"), "source").alias("channel_id"), F.col("source").alias("channel_name"),
        F.col("lang").alias("genre"),
        F.date_format(published, "yyyy-MM-dd'T'00:00:00'Z'").alias("publish_date"),
        F.concat(F.lit("PT"), minutes.cast("string"), F.lit("M")).alias("duration_iso"),
        minutes.cast("double").alias("duration_minutes"),
        views.alias("view_count"), (views % 1000).alias("like_count"),
        watch_url(video).alias("video_url")]


def _segments_column() -> Column:
    """Timed segments with gaps, noise markers, entities and too-short pieces."""
    late = F.col("doc_id") % 5 == 0

    def segment(line: Column, pos: Column) -> Column:
        return F.struct(
            F.concat(
                F.when(pos % 17 == 3, "[Music] ").otherwise(""), line,
                F.when(pos % 11 == 5, " &amp; more").otherwise("")).alias("text"),
            (pos * 4.0 + F.when(late & (pos >= 10), 40).otherwise(0)).cast("double").alias("start"),
            F.when(pos % 13 == 7, 0.01).otherwise(3.5).cast("double").alias("duration"))

    return F.transform(F.split("text", "\n", -1), segment).alias("segments")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*_metadata_columns())


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("video_id"), _segments_column())


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and segments side by side, without metrics."""
    return episodes_of(documents(spark, sf_dir))


def episodes_of(docs: DataFrame) -> DataFrame:
    """Episodes of a batch or a stream of documents."""
    return docs.select(
        *_metadata_columns(), _segments_column()).withColumnRenamed("duration_minutes", "duration_min")


def payload_of(docs: DataFrame) -> DataFrame:
    """Landing rows of a batch of documents."""
    source = F.concat("channel_name", F.lit("/"), "video_id")
    return stamp(with_load_metrics(episodes_of(docs)), source)


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows: metadata, segments and load-time metrics of each episode."""
    return payload_of(documents(spark, sf_dir))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(
        F.concat(F.lit("UC"), "source").alias("channel_id")
    ).agg(
        F.min("source").alias("channel_name"), F.min("lang").alias("genre")
    ).withColumn("youtube_url", F.concat(F.lit(fixed.CHANNEL_URL), "channel_id"))


#: ways to say it: hedged, certain, negated, plain
WORDINGS = ["will maybe", "will certainly", "will never", "could possibly", "may in many more different words slowly",
            "is about to"]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims made by customers; the nation is the channel."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def pick(c: Column, values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int"))

    video = (key % 200).cast("string")
    return joined.select(
        key.cast("string").alias("claim_id"), video.alias("video_id"),
        F.concat(video, F.lit("_chunk_0000")).alias("chunk_id"),
        F.concat(
            F.lit("Claim "), key.cast("string"), F.lit(" says that segment "), "c_mktsegment",
            F.lit(" "), pick(key % 97, WORDINGS), F.lit(" move by "), (cust % 90).cast("string"), F.lit(" percent")
        ).alias("claim_text"),
        # one topic in nine belongs to a single speaker
        F.when(cust % 9 == 4, F.concat(F.lit("S"), cust.cast("string"))).otherwise(
            F.concat(F.lit("T"), (key % 400).cast("string"))).alias("topic"),
        pick(cust, ["VERIFIABLE_FACT", "PREDICTION", "OPINION", "STATISTICAL"]).alias("claim_type"),
        pick(key, ["positive", "negative", "neutral"]).alias("sentiment"),
        F.when(cust % 10 == 0, "Unknown").otherwise(F.col("c_name")).alias("speaker"),
        F.lit("GUEST").alias("speaker_role"),
        pick(key, ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]).alias("attribution_confidence"),
        F.col("n_name").alias("channel_name"),
        F.col("o_orderdate").cast("date").alias("claim_date"),
        F.concat(watch_url(video), F.lit("&t=0s")).alias("youtube_url"),
        pick(key, ["PENDING", "VERIFIED", "OUTDATED", "DISPUTED", "UNVERIFIED", "FALSE"]
             ).alias("verification_status"))


GUEST_FIRST = ["Ann", "Bob", "Carla", "Dev", "Eli"]
GUEST_LAST = ["Stone", "Rivera", "Okafor", "Lind", "Sato", "Moreau", "Khan"]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episode titles in six shapes over four channels."""
    key = F.col("c_custkey")

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))

    name, number = F.concat(pick(GUEST_FIRST), F.lit(" "), pick(GUEST_LAST)), key.cast("string")
    shapes = [
        F.concat(name, F.lit(": On markets | Show #"), number),
        F.concat(F.lit("On markets - "), name),
        F.concat(F.lit("On markets | "), name, F.lit(" (Acme)")),
        F.concat(F.lit("Talk with "), name),
        F.lit("Notes on markets"),
        F.concat(F.lit("#"), number, F.lit(" - "), name),
    ]
    return table(spark, sf_dir, "customer").select(
        number.alias("video_id"),
        F.concat(F.lit("Show "), (F.col("c_nationkey") % 4).cast("string")).alias("channel_name"),
        F.get(F.array(*shapes), (key % 6).cast("int")).alias("episode_title"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as model answers: plain, fenced, wrapped in prose, broken."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(F.lit("PREDICTION"), F.lit("guess"), F.lit("opinion")), (key % 3).cast("int"))
    claim = F.concat(
        F.lit('{"claim_text":"Claim '), key.cast("string"),
        F.lit(' is long enough","claim_type":"'), kind, F.lit('","speaker_name":"'),
        F.when(cust % 5 == 0, "").otherwise(F.concat(F.lit("P"), cust.cast("string"))),
        F.lit('","topic":"t"}'))
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit("["), claim, F.lit("]")))
        .when(key % 4 == 1, F.concat(F.lit("```json\n["), claim, F.lit("]\n```")))
        .when(key % 4 == 2, F.concat(F.lit("Here: ["), claim, F.lit(',{"claim_text":"short"}] done')))
        .otherwise("[{broken"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat((key % 200).cast("string"), F.lit("_chunk_0000")).alias("chunk_id"),
        (key % 200).cast("string").alias("video_id"), key.cast("string").alias("prompt_id"),
        raw.alias("raw"))


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("search_id"), F.col("user_id").alias("session_id"),
        F.col("event_type").alias("query_type"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.col("ts").alias("created_at"))
