"""Time-anchored text chunks.

``chunk_payload`` and its variants read the episode row with its segment array and are
map-only. ``chunk_segments`` is for tables that hold one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmine.functions import segments as seg
from talkmine.functions.text import deep_link, padded, quality_tier, safe_ts, space_count

CONTEXT = ["video_id", "channel_id", "channel_name", "genre"]


def chunk_id(video_id: Column, window: Column) -> Column:
    return F.concat(video_id, F.lit("_chunk_"), padded(window, 4))


def _episode_context() -> list[Column]:
    return [
        *[F.col(c) for c in CONTEXT],
        F.col("title").alias("episode_title"),
        safe_ts(F.col("publish_date").cast("string")).cast("timestamp_ntz").alias("publish_date"),
        quality_tier(F.col("coverage_pct"), "chunk").alias("transcript_quality"),
    ]


def _finish(chunks: DataFrame, min_chars: int, more: list[str] = ()) -> DataFrame:
    return chunks.filter(F.length("chunk_text") > min_chars).select(
        chunk_id(F.col("video_id"), F.col("chunk_window")).alias("chunk_id"),
        *CONTEXT, "episode_title", "publish_date", "transcript_quality", "chunk_window",
        "chunk_text", "chunk_start_sec", "chunk_end_sec",
        (F.col("chunk_end_sec") - F.col("chunk_start_sec")).alias("chunk_duration_sec"),
        "segment_count", "word_count",
        deep_link(F.col("video_id"), F.col("chunk_start_sec"), "s").alias("youtube_url"), *more,
    )


def _made(groups: Column) -> Column:
    return F.transform(groups, lambda g: F.struct(
        F.get(g, F.lit(0))["w"].alias("chunk_window"),
        seg.joined(g).alias("chunk_text"),
        seg.first_start(g).alias("chunk_start_sec"),
        seg.last_end(g).alias("chunk_end_sec"),
        F.size(g).cast("long").alias("segment_count"),
        seg.spaced_words(g).alias("word_count")))


def _from_groups(payload: DataFrame, groups: Column, min_chars: int) -> DataFrame:
    """Turn each group of segments into one chunk inside the row, then explode."""
    rows = payload.select(*_episode_context(), F.explode(_made(groups)).alias("c"))
    return _finish(rows.select(
        *CONTEXT, "episode_title", "publish_date", "transcript_quality", "c.*"), min_chars)


def chunk_payload(payload: DataFrame, window: int = 120, min_chars: int = 50) -> DataFrame:
    """Disjoint windows by segment start; text in time order; near-empty chunks dropped."""
    return chunk_sliding(payload, window, 0, min_chars)


def chunk_neighbors(payload: DataFrame, window: int = 120, min_chars: int = 50) -> DataFrame:
    """The chunks of ``chunk_payload`` with the id and text of the previous and the next one.

    Neighbours are found inside the episode's row before its chunks become rows, so no text is
    shuffled. ``with_neighbors`` does the same for a table of chunks.
    """
    kept = F.filter(_made(seg.window_groups(F.col("segments"), window, window)), lambda c: F.length(c["chunk_text"]) > min_chars)
    ordered = payload.select(*_episode_context(), F.sort_array(kept).alias("made"))

    def beside(c: Column, name: str) -> Column:
        return F.when(c.isNotNull(), F.struct(
            chunk_id(F.col("video_id"), c["chunk_window"]).alias("id"), c["chunk_text"].alias("text"))).alias(name)

    paired = F.transform("made", lambda c, i: F.struct(
        c.alias("c"), beside(F.get(F.col("made"), i - 1), "p"), beside(F.get(F.col("made"), i + 1), "n")))
    rows = ordered.select(*[c for c in ordered.columns if c != "made"], F.explode(paired).alias("x"))
    beside_columns = {"previous_segment_id": "x.p.id", "previous_text": "x.p.text",
                      "next_segment_id": "x.n.id", "next_text": "x.n.text"}
    flat = rows.select(*CONTEXT, "episode_title", "publish_date", "transcript_quality", "x.c.*",
                       *[F.col(path).alias(name) for name, path in beside_columns.items()])
    return _finish(flat, min_chars, list(beside_columns))


def chunk_sliding(
    payload: DataFrame, size: int = 60, overlap: int = 15, min_chars: int = 50
) -> DataFrame:
    """Windows of ``size`` seconds that share ``overlap`` seconds with the next one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    groups = seg.window_groups(F.col("segments"), size, size - overlap)
    return _from_groups(payload, groups, min_chars)


def chunk_sentences(
    payload: DataFrame, target: int = 120, overlap: int = 15, min_chars: int = 50
) -> DataFrame:
    """Windows filled with whole sentences.

    A sentence belongs to the window its first segment starts in, and also to the next
    window when it starts in the last ``overlap`` seconds before it. A sentence without an end,
    as in captions without punctuation, is closed after the window that follows its first.
    """
    sentences = seg.sentences(F.col("segments"), target)

    def placed(sentence: Column) -> Column:
        begin = seg.first_start(sentence)
        window = F.floor(begin / target)
        reach = F.floor((begin + overlap) / target)
        return F.flatten(F.transform(F.sequence(window, reach), lambda w: F.transform(
            sentence, lambda s: F.struct(
                w.alias("w"), s["start"].alias("start"), s["pos"].alias("pos"),
                s["text"].alias("text"), s["duration"].alias("duration")))))

    spread = F.sort_array(F.flatten(F.transform(sentences, placed)))
    groups = seg.runs(spread, lambda s, p: s["w"] != p["w"])
    return _from_groups(payload, groups, min_chars)


def chunk_segments(
    segments: DataFrame, window: int = 120, min_chars: int = 50, text_col: str = "text_raw"
) -> DataFrame:
    """The same chunks from a table of segments; a group is one window of one episode."""
    text = F.col(text_col)
    rows = segments.filter(text.isNotNull() & (F.trim(text) != "")).select(
        *CONTEXT, "episode_title", "publish_date", "transcript_quality",
        F.floor(F.col("start_time") / window).alias("chunk_window"),
        "segment_index", text.alias("t"), "start_time",
        (F.col("start_time") + F.col("duration_sec")).alias("end_time"))
    grouped = rows.groupBy(
        *CONTEXT, "episode_title", "publish_date", "transcript_quality", "chunk_window"
    ).agg(
        F.expr("listagg(t, ' ') within group (order by start_time, segment_index)").alias("chunk_text"),
        F.min("start_time").alias("chunk_start_sec"),
        F.max("end_time").alias("chunk_end_sec"),
        F.count("*").alias("segment_count"),
        F.sum(space_count(F.col("t"))).alias("word_count"))
    return _finish(grouped, min_chars)


def with_neighbors(chunks: DataFrame, span: int = 512) -> DataFrame:
    """Add the previous and next chunk of the episode (id and text).

    Episodes are cut into blocks of ``span`` windows so that one very long episode is spread
    over many tasks; the rows at block borders take their neighbour from a small table of
    first and last chunks per block.
    """
    item = F.struct(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text"))
    rows = chunks.withColumn("_block", F.floor(F.col("chunk_window") / span))
    inside = Window.partitionBy("video_id", "_block").orderBy("chunk_window")
    rows = rows.withColumns({"_prev": F.lag(item).over(inside), "_next": F.lead(item).over(inside)})

    across = Window.partitionBy("video_id").orderBy("_block")
    borders = (
        chunks.withColumn("_block", F.floor(F.col("chunk_window") / span))
        .groupBy("video_id", "_block")
        .agg(F.min_by(item, "chunk_window").alias("first"), F.max_by(item, "chunk_window").alias("last"))
        .select("video_id", "_block",
                F.lag("last").over(across).alias("_before"),
                F.lead("first").over(across).alias("_after"))
    )
    joined = rows.join(borders, ["video_id", "_block"], "left")
    prev, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    return joined.withColumns({
        "previous_segment_id": prev["id"], "previous_text": prev["text"],
        "next_segment_id": after["id"], "next_text": after["text"],
    }).drop("_block", "_prev", "_next", "_before", "_after")


def episode_excerpt(chunks: DataFrame, windows: int = 5, chars: int = 3000) -> DataFrame:
    """First windows of each episode in order; the text is cut where the prompt ends."""
    return (
        chunks.filter(F.col("chunk_window") < windows)
        .groupBy("video_id", "channel_name", "genre", "episode_title", "publish_date")
        .agg(F.expr("listagg(chunk_text, ' ') within group (order by chunk_start_sec, chunk_id)")
             .alias("full_transcript_sample"))
        .withColumn("excerpt", F.left("full_transcript_sample", F.lit(chars)))
    )


def chunk_length_stats(chunks: DataFrame) -> DataFrame:
    size = F.length("chunk_text").cast("long")
    return chunks.agg(
        F.round(F.avg(size)).alias("avg_chars"), F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"))
