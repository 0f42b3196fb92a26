"""Row types of the inputs and tables."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
])
SEGMENTS = T.ArrayType(SEGMENT)

METADATA = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("channel_id", T.StringType()),
    T.StructField("channel_name", T.StringType()),
    T.StructField("publish_date", T.StringType()),
    T.StructField("duration_iso", T.StringType()),
    T.StructField("duration_minutes", T.DoubleType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("video_url", T.StringType()),
])

CHANNEL_LIST = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("target_episodes_total", T.LongType()),
        T.StructField("default_episodes_per_channel", T.LongType()),
        T.StructField("date_range", T.StringType()),
        T.StructField("min_duration_minutes", T.DoubleType()),
        T.StructField("max_duration_minutes", T.DoubleType()),
    ])),
    T.StructField("channels", T.ArrayType(T.StructType([
        T.StructField("channel_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("target_episodes", T.LongType()),
        T.StructField("notes", T.StringType()),
    ]))),
])

LEDGER = T.StructType([
    T.StructField("channels", T.MapType(T.StringType(), T.StructType([
        T.StructField("downloaded_ids", T.ArrayType(T.StringType())),
        T.StructField("last_downloaded", T.StringType()),
        T.StructField("last_stratified_extraction", T.StringType()),
    ]))),
    T.StructField("last_updated", T.StringType()),
])

CLAIM_RESPONSE = T.ArrayType(T.StructType([
    T.StructField("claim_text", T.StringType()),
    T.StructField("speaker_name", T.StringType()),
    T.StructField("speaker_role", T.StringType()),
    T.StructField("attribution_confidence", T.StringType()),
    T.StructField("claim_type", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("sentiment", T.StringType()),
]))

ENTITY_RESPONSE = T.StructType([
    T.StructField("people", T.ArrayType(T.StringType())),
    T.StructField("organizations", T.ArrayType(T.StringType())),
    T.StructField("technologies", T.ArrayType(T.StringType())),
])

DRIFT_RESPONSE = T.StructType([
    T.StructField("drift_type", T.StringType()),
    T.StructField("analysis", T.StringType()),
])
