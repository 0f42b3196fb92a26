"""Staging, chunking, metrics and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmine.operators import chunking, metrics, staging
from talkmine.plans.oracle import sql
from talkmine.plans.registry import query
from talkmine.sources import tables as t


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


CHUNK_COLUMNS = [
    "chunk_id", "video_id", "channel_id", "channel_name", "genre", "episode_title",
    "transcript_quality", "chunk_window", "chunk_text", "chunk_start_sec", "chunk_end_sec",
    "chunk_duration_sec", "segment_count", "word_count", "youtube_url",
]


def chunks(spark, sf):
    return chunking.chunk_payload(t.payload(spark, sf))


_CHUNK_SQL = """
select chunk_id, video_id, channel_id, channel_name, genre, episode_title,
 strftime(publish_date, '%Y-%m-%d') as publish_date, transcript_quality, w as chunk_window, chunk_text,
 chunk_start_sec, chunk_end_sec, chunk_end_sec - chunk_start_sec as chunk_duration_sec,
 segment_count, word_count, youtube_url from chunks"""


@query("chunk_fixed_window", sql(_CHUNK_SQL, "chunks"))
def chunk_fixed_window(spark, sf):
    return chunks(spark, sf).select(*CHUNK_COLUMNS, day("publish_date"))


@query("chunk_segment_table", sql("""
select concat(video_id, '_chunk_', lpad(cast(w as varchar), 4, '0')) as chunk_id, chunk_text,
 segment_count, word_count from (
 select video_id, cast(floor(start / 120) as bigint) as w,
  string_agg(clean, ' ' order by start, segment_index) as chunk_text, count(*) as segment_count,
  cast(sum(len(string_split(clean, ' '))) as bigint) as word_count
 from (select *, trim(regexp_replace(regexp_replace(text,
   '\\[Music\\]|\\[Applause\\]|\\[Laughter\\]|\\[Cheering\\]|\\[Inaudible\\]', '', 'gi'),
   '&amp;|&gt;|&lt;|&nbsp;', ' ', 'g')) as clean from segments
  where duration > 0.05 and length(trim(text)) > 2 and not (text ilike '%[Music]%'
   or text ilike '%[Applause]%' or text ilike '%[Laughter]%')) s
 where trim(clean) <> '' group by 1, 2) c where length(chunk_text) > 50""", "segments"))
def chunk_segment_table(spark, sf):
    """Chunks of cleaned text, from the segment view instead of the landing rows."""
    found = segments_with_episode(spark, sf)
    return chunking.chunk_segments(found, text_col="text_clean").select(
        "chunk_id", "chunk_text", "segment_count", "word_count")


@query("chunk_sliding", sql("""
select concat(video_id, '_chunk_', lpad(cast(w as varchar), 4, '0')) as chunk_id, w as chunk_window,
 chunk_text, chunk_start_sec, segment_count from (
 select video_id, w, string_agg(text, ' ' order by start, segment_index) as chunk_text,
  min(start) as chunk_start_sec, count(*) as segment_count
 from (select *, unnest(range(greatest(cast(floor((start - 60) / 45) as bigint) + 1, 0),
   cast(floor(start / 45) as bigint) + 1)) as w from segments where trim(text) <> '') s
 group by 1, 2) c where length(chunk_text) > 50""", "segments"))
def chunk_sliding(spark, sf):
    return chunking.chunk_sliding(t.payload(spark, sf)).select(
        "chunk_id", "chunk_window", "chunk_text", "chunk_start_sec", "segment_count")


@query("chunk_sentence_aligned", sql("""
, kept as (select *, row_number() over (partition by video_id order by start, segment_index) as n
  from segments where trim(text) <> ''),
 marked as (select *, coalesce(sum(case when regexp_matches(text, '[.!?]\\s*$') then 1 else 0 end)
   over (partition by video_id order by n rows between unbounded preceding and 1 preceding), 0) as s from kept),
 placed as (select *, min(start) over (partition by video_id, s) as begins from marked),
 spread as (select *, unnest(range(cast(floor(begins / 120) as bigint),
   cast(floor((begins + 15) / 120) as bigint) + 1)) as w from placed)
select concat(video_id, '_chunk_', lpad(cast(w as varchar), 4, '0')) as chunk_id, chunk_text, segment_count
from (select video_id, w, string_agg(text, ' ' order by start, segment_index) as chunk_text,
  count(*) as segment_count from spread group by 1, 2) c
where length(chunk_text) > 50""", "segments"))
def chunk_sentence_aligned(spark, sf):
    return chunking.chunk_sentences(t.payload(spark, sf)).select(
        "chunk_id", "chunk_text", "segment_count")


@query("chunk_neighbors", sql("""
select chunk_id, coalesce(lag(chunk_id) over o, '') as previous_segment_id,
 coalesce(lead(chunk_id) over o, '') as next_segment_id,
 coalesce(length(lag(chunk_text) over o), 0) as previous_chars,
 coalesce(length(lead(chunk_text) over o), 0) as next_chars
from chunks window o as (partition by video_id order by w)""", "chunks"))
def chunk_neighbors(spark, sf):
    return chunking.with_neighbors(chunks(spark, sf)).select(
        "chunk_id", "previous_segment_id", "next_segment_id",
        F.length("previous_text").cast("long").alias("previous_chars"),
        F.length("next_text").cast("long").alias("next_chars")).fillna("").fillna(0)


@query("chunk_neighbors_in_row", sql("""
select chunk_id, md5(chunk_text) as text, coalesce(lag(chunk_id) over o, '') as previous_segment_id,
 coalesce(lead(chunk_id) over o, '') as next_segment_id,
 coalesce(md5(lag(chunk_text) over o), '') as previous_text, coalesce(md5(lead(chunk_text) over o), '') as next_text
from chunks window o as (partition by video_id order by w)""", "chunks"))
def chunk_neighbors_in_row(spark, sf):
    """Each chunk with its neighbours' ids and whole texts, found before chunks are rows."""
    return chunking.chunk_neighbors(t.payload(spark, sf)).select(
        "chunk_id", F.md5("chunk_text").alias("text"), "previous_segment_id", "next_segment_id",
        F.md5("previous_text").alias("previous_text"), F.md5("next_text").alias("next_text")).fillna("")


@query("episode_excerpt", sql("""
select video_id, left(string_agg(chunk_text, ' ' order by chunk_start_sec, chunk_id), 3000) as excerpt
from chunks where w <= 4 group by 1""", "chunks"))
def episode_excerpt(spark, sf):
    return chunking.episode_excerpt(chunks(spark, sf)).select("video_id", "excerpt")


@query("chunk_length_stats", sql("""
select round(avg(length(chunk_text))) as avg_chars, min(length(chunk_text)) as min_chars,
 max(length(chunk_text)) as max_chars from chunks""", "chunks"))
def chunk_length_stats(spark, sf):
    return chunking.chunk_length_stats(chunks(spark, sf))


@query("stg_episodes", sql("""
select video_id, channel_id, channel_name, genre, title, strftime(publish_date, '%Y-%m-%d') as publish_date,
 duration_min, view_count, like_count, segment_count, total_words, coverage_pct, artifact_count,
 gap5 as has_timestamp_gaps, words_per_minute, round(avg_duration, 7) as avg_segment_len_sec,
 year(publish_date) as publish_year, video_url as youtube_base_url from metrics""", "metrics"))
def stg_episodes(spark, sf):
    return staging.stg_episodes(t.payload(spark, sf)).drop(
        "load_timestamp", "source_file", "duration_iso", "video_url"
    ).withColumn("publish_date", F.date_format("publish_date", "yyyy-MM-dd"))


@query("int_episodes", sql("""
select video_id, concat('https://www.youtube.com/channel/', channel_id) as channel_url,
 round(duration_min * 60) as duration_seconds, round(total_words / duration_min, 1) as words_per_min,
 cast(floor(duration_min / 120) as bigint) + 1 as estimated_chunks,
 cast(floor(duration_min * 60 / 120) as bigint) + 1 as estimated_chunks_sec,
 case when coverage_pct >= 0.9 then 'HIGH' when coverage_pct >= 0.7 then 'MEDIUM' else 'LOW' end
  as transcript_quality,
 round(like_count / nullif(view_count, 0) * 100, 4) as engagement_rate from metrics""", "metrics"))
def int_episodes(spark, sf):
    return staged_episodes(spark, sf).select(
        "video_id", "channel_url", "duration_seconds", "words_per_min", "estimated_chunks",
        "estimated_chunks_sec", "transcript_quality", "engagement_rate")


def staged_episodes(spark, sf):
    return staging.int_episodes(
        staging.stg_episodes(t.payload(spark, sf)), t.channels(spark, sf))


def segments_with_episode(spark, sf):
    payload = t.payload(spark, sf)
    return staging.int_segments(
        staging.stg_segments(payload),
        staging.int_episodes(staging.stg_episodes(payload), t.channels(spark, sf)))


_CLEAN = """trim(regexp_replace(regexp_replace(text,
 '\\[Music\\]|\\[Applause\\]|\\[Laughter\\]|\\[Cheering\\]|\\[Inaudible\\]', '', 'gi'),
 '&amp;|&gt;|&lt;|&nbsp;', ' ', 'g'))"""


@query("stg_segments_clean", sql(f"""
select concat(video_id, '_', lpad(cast(segment_index as varchar), 5, '0')) as segment_id, segment_index,
 {_CLEAN} as text_clean, start as start_time, start + duration as end_time,
 (text ilike '%[Music]%' or text ilike '%[Applause]%' or text ilike '%[Laughter]%') as is_artifact
from segments where duration > 0.05 and length(trim(text)) > 2""", "segments"))
def stg_segments_clean(spark, sf):
    return staging.stg_segments(t.payload(spark, sf)).select(
        "segment_id", "segment_index", "text_clean", "start_time", "end_time", "is_artifact")


@query("int_segments", sql(f"""
select concat(s.video_id, '_', lpad(cast(segment_index as varchar), 5, '0')) as segment_id,
 m.title as episode_title, m.duration_min as episode_duration_min,
 case when coverage_pct >= 0.9 then 'HIGH' when coverage_pct >= 0.7 then 'MEDIUM' else 'LOW' end
  as transcript_quality,
 concat('https://www.youtube.com/watch?v=', s.video_id, '&t=', cast(cast(floor(start) as bigint) as varchar))
  as youtube_timestamp_url,
 len(string_split({_CLEAN}, ' ')) as word_count
from segments s left join metrics m on s.video_id = m.video_id
where duration > 0.05 and length(trim(text)) > 2 and not (text ilike '%[Music]%'
 or text ilike '%[Applause]%' or text ilike '%[Laughter]%')""", "segments", "metrics"))
def int_segments(spark, sf):
    return segments_with_episode(spark, sf).select(
        "segment_id", "episode_title", "episode_duration_min", "transcript_quality",
        "youtube_timestamp_url", "word_count")


@query("quality_tiers", sql("""
select case when coverage_pct >= 0.9 then 'HIGH' when coverage_pct >= 0.7 then 'MEDIUM' else 'LOW' end
  as view_tier,
 case when coverage_pct >= 0.85 then 'HIGH' when coverage_pct >= 0.65 then 'MEDIUM' else 'LOW' end
  as chunk_tier, count(*) as episodes from metrics group by 1, 2""", "metrics"))
def quality_tiers(spark, sf):
    from talkmine.functions.text import quality_tier
    return t.payload(spark, sf).groupBy(
        quality_tier(F.col("coverage_pct"), "view").alias("view_tier"),
        quality_tier(F.col("coverage_pct"), "chunk").alias("chunk_tier"),
    ).agg(F.count("*").alias("episodes"))


@query("episode_metrics", sql("""
select video_id, segment_count, total_words, artifact_count, empty_segments, gap30 as has_timestamp_gaps,
 round(covered, 6) as duration_covered, round(covered / (duration_min * 60), 9) as coverage_pct,
 round(total_words / duration_min, 9) as words_per_minute, round(avg_duration, 9) as avg_segment_duration
from metrics""", "metrics"))
def episode_metrics(spark, sf):
    return metrics.profile_metrics(t.episodes(spark, sf)).select(
        "video_id", "segment_count", "total_words", "artifact_count", "empty_segments",
        "has_timestamp_gaps", F.round("duration_covered", 6).alias("duration_covered"),
        F.round("coverage_pct", 9).alias("coverage_pct"),
        F.round("words_per_minute", 9).alias("words_per_minute"),
        F.round("avg_segment_duration", 9).alias("avg_segment_duration"))


def scored(spark, sf):
    return metrics.with_quality(metrics.profile_metrics(t.episodes(spark, sf)))


@query("quality_score", sql("""
select video_id, quality_score,
 case when quality_score > 0.7 then 'HIGH' when quality_score >= 0.5 then 'MEDIUM' else 'LOW' end
  as quality_band, quality_score >= 0.5 as accepted from scored""", "scored"))
def quality_score(spark, sf):
    return scored(spark, sf).select("video_id", "quality_score", "quality_band", "accepted")


@query("corpus_profile", sql("""
select count(*) as episodes, count(*) filter (quality_score > 0.7) as high,
 count(*) filter (quality_score between 0.5 and 0.7) as medium,
 count(*) filter (quality_score < 0.5) as low, count(*) filter (quality_score >= 0.5) as accepted,
 count(*) filter (quality_score < 0.5) as rejected,
 cast(sum(segment_count) as bigint) as total_segments,
 round(sum(segment_count) / count(*), 4) as avg_segments,
 cast(sum(total_words) as bigint) as total_words, round(sum(total_words) / count(*), 4) as avg_words,
 round(sum(artifact_count) * 100.0::double / sum(segment_count), 4) as artifact_rate,
 round(sum(empty_segments) * 100.0::double / sum(segment_count), 4) as empty_rate,
 count(*) filter (gap30) as gap_episodes,
 round(count(*) filter (gap30) * 100.0::double / count(*), 4) as gap_rate,
 round(avg(wpm), 4) as avg_wpm, round(min(wpm), 4) as min_wpm, round(max(wpm), 4) as max_wpm,
 round(sum(duration_min) / 60, 4) as total_hours, round(avg(duration_min), 4) as avg_duration,
 round(avg(cov) * 100, 4) as avg_coverage, count(distinct channel_name) as channels,
 count(distinct genre) as genres from scored""", "scored"))
def corpus_profile(spark, sf):
    return metrics.corpus_profile(scored(spark, sf))


def _breakdown_sql(by: str) -> str:
    return sql(f"""
select {by}, count(*) as episodes, count(*) filter (quality_score >= 0.5) as accepted,
 round(avg(quality_score), 4) as avg_quality, cast(sum(total_words) as bigint) as total_words
from scored group by 1""", "scored")


@query("genre_breakdown", _breakdown_sql("genre"))
def genre_breakdown(spark, sf):
    return metrics.breakdown(scored(spark, sf), "genre")


@query("channel_breakdown", _breakdown_sql("channel_name"))
def channel_breakdown(spark, sf):
    return metrics.breakdown(scored(spark, sf), "channel_name")


@query("configured_channels", sql("""
select c.channel_name, count(s.video_id) as episodes, count(s.video_id) > 0 as has_data
from (select distinct source as channel_name from documents union select n_name from nation) c
left join scored s using (channel_name) group by 1""", "scored"))
def configured_channels(spark, sf):
    config = t.table(spark, sf, "documents").select(F.col("source").alias("channel_name")).union(
        t.table(spark, sf, "nation").select("n_name")).distinct()
    return metrics.configured_coverage(scored(spark, sf), config)


@query("bottom_episodes", sql("""
select video_id, quality_score from scored order by quality_score, video_id limit 5""", "scored"))
def bottom_episodes(spark, sf):
    return metrics.bottom_k(scored(spark, sf)).select("video_id", "quality_score")


@query("episode_leaderboard", sql("""
select row_number() over (order by quality_score desc, channel_name, video_id) as place, video_id,
 quality_score from scored qualify place <= 100""", "scored"))
def episode_leaderboard(spark, sf):
    from talkmine.operators.selection import ranked
    return ranked(scored(spark, sf), [F.desc("quality_score"), "channel_name", "video_id"], 100).select(
        F.col("rank").alias("place"), "video_id", "quality_score")


PROFILED = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("column_profile", " union all ".join(f"""
select '{c}' as column_name, count(*) as n, count(*) filter ({c} is null) as n_null,
 count(*) filter ({c} = 0) as n_zero, count(distinct {c}) as n_distinct,
 cast(min({c}) as double) as min_value, cast(max({c}) as double) as max_value,
 round(avg({c}), 4) as mean_value, round(stddev({c}), 4) as std_value,
 round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) as skewness
from orders, (select avg({c}) as m from orders)""" for c in PROFILED))
def column_profile(spark, sf):
    return metrics.column_profile(t.table(spark, sf, "orders"), PROFILED).withColumns(
        {c: F.round(c, 4) for c in ("mean_value", "std_value", "skewness")})


@query("column_quantiles", " union all ".join(
    f"select '{x}' as column_name, " + ", ".join(
        f"quantile_disc({x}, {p})::double as q{int(p * 100):02d}" for p in (0.25, 0.5, 0.75)) + " from orders"
    for x in PROFILED))
def column_quantiles(spark, sf):
    return metrics.column_quantiles(t.table(spark, sf, "orders"), PROFILED)


@query("column_correlations", " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from orders"
    for i, a in enumerate(PROFILED) for b in PROFILED[i + 1:]))
def column_correlations(spark, sf):
    return metrics.correlations(t.table(spark, sf, "orders"), PROFILED).withColumn(
        "correlation", F.round("correlation", 6))


@query("duplicate_rows", """
select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows, count(*) filter (n > 1) as duplicated_keys
from (select text, count(*) as n from documents group by 1)""")
def duplicate_rows(spark, sf):
    return metrics.duplicate_rows(t.table(spark, sf, "documents"), ["text"])


@query("metrics_with_missing", sql("""
select m.video_id, l.doc_id is not null as has_transcript,
 case when l.doc_id is null then 0 else m.total_words end as total_words,
 case when l.doc_id is null then 0.0 else round(m.covered, 6) end as duration_covered,
 case when l.doc_id is null then 0.0 else round(m.total_words / (m.covered / 60), 6) end as words_per_minute,
 case when l.doc_id is null then 0.0 else round(m.covered / m.segment_count, 6) end as avg_segment_len_sec
from metrics m left join labels l on m.video_id = cast(l.doc_id as varchar)""", "metrics"))
def metrics_with_missing(spark, sf):
    """Only documents with a label count as transcribed here."""
    labelled = t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("video_id"))
    found = t.transcripts(spark, sf).join(labelled, "video_id", "left_semi")
    return metrics.metrics_with_missing(t.metadata(spark, sf), found).select(
        "video_id", "has_transcript", "total_words",
        *[F.round(c, 6).alias(c) for c in ("duration_covered", "words_per_minute", "avg_segment_len_sec")])


@query("stg_episodes_variant", sql("""
select video_id, title, strftime(publish_date, '%Y-%m-%d') as publish_date, duration_min, view_count,
 segment_count, coverage_pct, gap5 as has_timestamp_gaps from metrics""", "metrics"))
def stg_episodes_variant(spark, sf):
    """The staging view over a landing table that keeps the whole document in one VARIANT."""
    payload = t.payload(spark, sf)
    document = F.struct(*[c for c in payload.columns if c not in ("load_timestamp", "source_file")])
    raw = payload.select(F.parse_json(F.to_json(document)).alias("raw_data"), "load_timestamp", "source_file")
    return staging.stg_episodes(staging.variant_payload(raw)).select(
        "video_id", "title", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"), "duration_min",
        "view_count", "segment_count", "coverage_pct", "has_timestamp_gaps")


@query("strip_overlap", sql("""
, spoken as (select *, lag(text) over (partition by video_id order by segment_index) as before from segments)
select video_id, segment_index, case when before is not null and before <> '' and starts_with(text, before)
 then ltrim(substring(text, length(before) + 1)) else text end as text from (
 select video_id, segment_index, lag(said) over (partition by video_id order by segment_index) as before, said as text
 from (select *, case when before is null or segment_index % 2 = 0 then text else concat(before, ' ', text) end as said
  from spoken) x) y""", "segments"))
def strip_overlap(spark, sf):
    """Rolling captions: every second line repeats the line before it."""
    from talkmine.functions import segments as seg
    from talkmine.functions.text import let

    def rolled(a):
        return F.transform(a, lambda s, i: F.struct(
            F.when((i == 0) | (i % 2 == 0), s["text"])
            .otherwise(F.concat(F.get(a, i - 1)["text"], F.lit(" "), s["text"])).alias("text"),
            s["start"].alias("start"), s["duration"].alias("duration")))

    shown = t.transcripts(spark, sf).withColumn("segments", let(F.col("segments"), rolled))
    rows = shown.select("video_id", F.posexplode(seg.strip_overlap(F.col("segments"))).alias("segment_index", "s"))
    return rows.select("video_id", F.col("segment_index").cast("long").alias("segment_index"), "s.text")


@query("drop_repeats", sql("""
select video_id, count(*) as kept from (select video_id, text,
 lag(text) over (partition by video_id order by segment_index) as before from segments) x
where before is null or before <> text group by 1""", "segments"))
def drop_repeats(spark, sf):
    from talkmine.functions import segments as seg
    return t.transcripts(spark, sf).select(
        "video_id", seg.segment_count(seg.drop_repeats(F.col("segments"))).alias("kept"))
