"""Typed staging views over the landing table: one row per episode, one row per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.text import (
    clean_text, deep_link, icontains, is_artifact, padded, quality_tier, ratio, safe_ts, space_count,
)

EPISODE_COLUMNS = {
    "video_id": "string", "channel_id": "string", "channel_name": "string", "genre": "string",
    "title": "string", "publish_date": "timestamp_ntz", "duration_min": "double",
    "duration_iso": "string", "video_url": "string", "view_count": "long", "like_count": "long",
    "segment_count": "long", "total_words": "long", "coverage_pct": "double",
    "artifact_count": "long", "has_timestamp_gaps": "boolean", "words_per_minute": "double",
    "avg_segment_len_sec": "double",
}

#: channels that may be sent to every task
SMALL_CHANNELS = 100_000


def variant_payload(raw: DataFrame) -> DataFrame:
    """Schema-on-read: pull the typed columns out of a VARIANT ``raw_data`` column."""
    typed = [F.try_variant_get("raw_data", f"$.{name}", kind).alias(name)
             for name, kind in EPISODE_COLUMNS.items() if name != "publish_date"]
    published = F.try_variant_get("raw_data", "$.publish_date", "string").alias("publish_date")
    segments = F.try_variant_get(
        "raw_data", "$.segments", "array<struct<text:string,start:double,duration:double>>"
    ).alias("segments")
    return raw.select(*typed, published, segments, "load_timestamp", "source_file")


def stg_episodes(payload: DataFrame) -> DataFrame:
    """22 typed columns per episode; rows without an id are dropped."""

    def column(name: str, kind: str) -> Column:
        c = F.col(name)
        if name == "publish_date":
            c = safe_ts(c.cast("string"))
        return c.cast(kind).alias(name)

    return payload.filter(F.col("video_id").isNotNull()).select(
        *[column(n, k) for n, k in EPISODE_COLUMNS.items()],
        F.year(safe_ts(F.col("publish_date").cast("string"))).cast("long").alias("publish_year"),
        F.col("video_url").alias("youtube_base_url"),
        "load_timestamp", "source_file",
    )


def with_channel(episodes: DataFrame, channels: DataFrame) -> DataFrame:
    """Attach the channel link. The channel table has one row per channel.

    A channel may have a large share of all episodes, so a table counted as small is sent to them.
    """
    links = channels.select("channel_id", F.col("youtube_url").alias("channel_url"))
    if links.count() <= SMALL_CHANNELS:
        links = F.broadcast(links)
    return episodes.join(links, "channel_id", "left")


def int_episodes(episodes: DataFrame, channels: DataFrame) -> DataFrame:
    minutes = F.col("duration_min")
    return with_channel(episodes, channels).select(
        "video_id", "channel_id", "channel_name", "genre", "title", "publish_date",
        "publish_year", "duration_min", "view_count", "like_count", "total_words",
        "segment_count", "coverage_pct", "artifact_count", "words_per_minute", "video_url",
        "channel_url",
        F.round(minutes * 60).alias("duration_seconds"),
        F.round(ratio(F.col("total_words"), minutes), 1).alias("words_per_min"),
        (F.floor(minutes / 120) + 1).alias("estimated_chunks"),
        (F.floor(minutes * 60 / 120) + 1).alias("estimated_chunks_sec"),
        quality_tier(F.col("coverage_pct"), "view").alias("transcript_quality"),
        F.round(ratio(F.col("like_count"), F.col("view_count")) * 100, 4).alias("engagement_rate"),
        "load_timestamp",
    )


def flatten_segments(payload: DataFrame) -> DataFrame:
    """One row per segment with its 0-based position; episodes without an array give none."""
    return payload.select(
        "video_id", "channel_id", "channel_name", "genre", "duration_min",
        F.posexplode("segments").alias("segment_index", "s"),
    ).select(
        "video_id", "channel_id", "channel_name", "genre", "duration_min",
        F.col("segment_index").cast("long").alias("segment_index"),
        F.col("s.text").alias("text_raw"), F.col("s.start").alias("start_time"),
        F.col("s.duration").alias("duration_sec"),
    )


def with_segment_keys(segments: DataFrame) -> DataFrame:
    return segments.withColumns({
        "end_time": F.col("start_time") + F.col("duration_sec"),
        "segment_id": F.concat(
            "video_id", F.lit("_"), padded(F.col("segment_index"), 5)),
    })


def drop_noise(segments: DataFrame) -> DataFrame:
    """Keep segments longer than 0.05 s with more than two characters."""
    return segments.filter(
        (F.col("duration_sec") > 0.05) & (F.length(F.trim("text_raw")) > 2))


def stg_segments(payload: DataFrame) -> DataFrame:
    flat = with_segment_keys(drop_noise(flatten_segments(payload)))
    return flat.withColumns({
        "text_clean": clean_text(F.col("text_raw")),
        "is_artifact": is_artifact(F.col("text_raw"), fixed.FLAG_MARKERS),
    })


def with_episode(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    context = episodes.select(
        "video_id", F.col("title").alias("episode_title"), "publish_date",
        F.col("duration_min").alias("episode_duration_min"), "transcript_quality",
        "engagement_rate")
    return segments.join(context, "video_id", "left")


def int_segments(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    spoken = segments.filter(~F.col("is_artifact")).drop("duration_min")
    return with_episode(spoken, episodes).withColumns({
        "youtube_timestamp_url": deep_link(F.col("video_id"), F.col("start_time")),
        "word_count": space_count(F.col("text_clean")),
    })


def narrowed(channels: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Condition on channel and date that a search applies before it ranks."""
    kept = F.lit(True)
    if channels:
        kept &= F.col("channel_name").isin(channels)
    if date_from:
        kept &= F.col("publish_date") >= F.lit(date_from).cast("date")
    if date_to:
        kept &= F.col("publish_date") <= F.lit(date_to).cast("date")
    return kept


def with_topic(rows: DataFrame, topics: DataFrame, topic: str, key: str = "chunk_id", name: str = "topic") -> DataFrame:
    """``rows`` with ``on_topic``: whether a topic (or entity) of theirs has the given text in it."""
    on = topics.filter(icontains(F.col(name), topic)).select(key).distinct().withColumn("on_topic", F.lit(True))
    return rows.join(on, key, "left").withColumn("on_topic", F.coalesce("on_topic", F.lit(False)))


def refine(
    hits: DataFrame, channels: list[str] | None = None, topic: str | None = None,
    date_from: str | None = None, date_to: str | None = None, sort: str = "relevance",
    score: str = "score", key: str = "chunk_id", topics: DataFrame | None = None,
) -> DataFrame:
    """Narrow a result by channel, topic and date; sort by relevance, date or channel.

    The topics of the hits are a column ``topic``, or a table ``topics`` of (key, topic). To rank what
    meets the conditions rather than narrow what was ranked, give them to the search.
    """
    hits = hits.filter(narrowed(channels, date_from, date_to))
    if topic and topics is not None:
        hits = with_topic(hits, topics, topic, key).filter("on_topic").drop("on_topic")
    elif topic:
        hits = hits.filter(icontains(F.col("topic"), topic))
    order = {"relevance": F.desc(score), "date": F.desc("publish_date"), "channel": F.asc("channel_name")}
    return hits.orderBy(order[sort], F.asc(key))
