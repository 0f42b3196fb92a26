"""Ingest, selection, incremental and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmine.functions.text import iso_minutes as iso
from talkmine.operators import claims as c
from talkmine.operators import quality as q
from talkmine.operators import search as s
from talkmine.operators import selection as sel
from talkmine.operators.metrics import merge_payload
from talkmine.plans.oracle import sql
from talkmine.plans.registry import query
from talkmine.plans.search import _CHUNK_BM25
from talkmine.plans.transcripts import chunks
from talkmine.session import fresh_dir
from talkmine.sources import files, sinks
from talkmine.sources import tables as t
from talkmine.streaming import refresh as r


def typed_metadata(spark, sf):
    return t.metadata(spark, sf).withColumnRenamed("duration_minutes", "duration_min").withColumn(
        "publish_date", F.to_date(F.left("publish_date", F.lit(10))))


def labelled(spark, sf):
    return t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("video_id"))


@query("candidates", sql("""
select video_id, duration_min from meta where duration_min between 30 and 180
 and publish_date >= date '2023-01-01' and genre = 'en'""", "meta"))
def candidates(spark, sf):
    rows = typed_metadata(spark, sf).withColumnRenamed("genre", "language")
    return sel.candidates(rows, 30, 180, "2023-01-01", "en").select("video_id", "duration_min")


@query("top_n_per_channel", sql("""
select channel_name, video_id, view_count, rank from (
 select *, row_number() over (partition by channel_name order by view_count desc, video_id) as rank from meta
 where video_id not in (select cast(doc_id as varchar) from labels)) x where rank <= 10""", "meta"))
def top_n_per_channel(spark, sf):
    return sel.top_n_per_key(
        typed_metadata(spark, sf), ["channel_name"], [F.desc("view_count"), "video_id"], 10, labelled(spark, sf)
    ).select("channel_name", "video_id", "view_count", F.col("rank").cast("long").alias("rank"))


TARGETS = [("src1", {2022: 3, 2023: 2, 2024: 4}, 30.0), ("src2", {2022: 1, 2025: 5}, 60.0),
           ("src7", {2023: 20}, 30.0)]
_TARGETS = ", ".join(f"('{name}', {year}, {n}, {least})" for name, years, least in TARGETS for year, n in years.items())
_STRATA = f"""
, targets as (select * from (values {_TARGETS}) v(channel_name, year, target, least)),
 picked as (select channel_name, year, target, video_id, rank from (
  select m.channel_name, t.year, t.target, video_id,
   row_number() over (partition by m.channel_name, t.year order by view_count desc, video_id) as rank
  from meta m join targets t on m.channel_name = t.channel_name and year(publish_date) = t.year
  where duration_min between least and 240
   and video_id not in (select cast(doc_id as varchar) from labels where quality = 1)) x where rank <= target)"""


def stratified(spark, sf):
    good = t.table(spark, sf, "labels").filter("quality = 1").select(
        F.col("doc_id").cast("string").alias("video_id"))
    return sel.stratified_top_n(typed_metadata(spark, sf), sel.target_table(spark, TARGETS), good)


@query("stratified_top_n", sql(_STRATA + " select channel_name, cast(year as bigint) as year, video_id, rank from picked", "meta"))
def stratified_top_n(spark, sf):
    return stratified(spark, sf).select(
        "channel_name", F.col("year").cast("long").alias("year"), "video_id", F.col("rank").cast("long").alias("rank"))


@query("stratum_summary", sql(_STRATA + """
 select t.channel_name, t.year, t.target, count(l.doc_id) as added,
  count(p.video_id) - count(l.doc_id) as failed
 from targets t left join picked p on t.channel_name = p.channel_name and t.year = p.year
 left join labels l on p.video_id = cast(l.doc_id as varchar) group by 1, 2, 3""", "meta"))
def stratum_summary(spark, sf):
    """Picks with a label count as fetched, the others as failed."""
    ok = labelled(spark, sf).withColumn("ok", F.lit("success"))
    results = stratified(spark, sf).join(ok, "video_id", "left").select(
        "channel_name", "year", F.coalesce("ok", F.lit("no_transcript")).alias("status"))
    return sel.stratum_summary(results, sel.target_table(spark, TARGETS)).withColumns(
        {x: F.col(x).cast("int") for x in ("year", "target")})


@query("channel_summary", sql("""
select m.channel_name, count(*) filter (l.quality is null or l.quality = 0) as attempted,
 count(*) filter (l.quality = 0) as succeeded, count(*) filter (l.quality is null) as failed,
 count(*) filter (l.quality = 1) as skipped
from meta m left join labels l on m.video_id = cast(l.doc_id as varchar) group by 1""", "meta"))
def channel_summary(spark, sf):
    marks = t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("video_id"), "quality")
    results = t.metadata(spark, sf).join(marks, "video_id", "left").withColumn(
        "status", F.when(F.col("quality") == 1, "held").when(F.col("quality") == 0, "success").otherwise("failed"))
    return sel.channel_summary(results)


@query("genre_lookup", """
select case doc_id % 5 when 0 then 'Science & Health' when 1 then 'Technology & AI' when 2 then 'Technology & AI'
 when 3 then 'Unknown' else 'Science & Health' end as genre, count(*) as episodes from documents group by 1""")
def genre_lookup(spark, sf):
    """Folder names that match exactly, that contain a key, that a key contains, and none."""
    key = F.col("doc_id") % 5
    folder = (
        F.when(key == 0, "Huberman-Lab").when(key == 1, "No Priors").when(key == 2, "acquired")
        .when(key == 3, F.concat(F.lit("zz"), "source")).otherwise("startalk_extra"))
    return t.table(spark, sf, "documents").groupBy(sel.genre_of(folder).alias("genre")).agg(
        F.count("*").alias("episodes"))


@query("iso_minutes", """
select o_orderkey, round(case o_orderkey % 4 when 0 then o_orderkey % 5 * 60 + o_orderkey % 60 + o_custkey % 60 / 60
 when 1 then o_orderkey % 60 when 2 then 0 else o_orderkey % 5 * 60 end::double, 6) as minutes from orders""")
def iso_minutes(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    h, m, sec = ((key % 5).cast("string"), (key % 60).cast("string"), (cust % 60).cast("string"))
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("PT"), h, F.lit("H"), m, F.lit("M"), sec, F.lit("S")))
        .when(key % 4 == 1, F.concat(F.lit("PT"), m, F.lit("M"))).when(key % 4 == 2, "P1D")
        .otherwise(F.concat(F.lit("PT"), h, F.lit("H"))))
    return t.table(spark, sf, "orders").select("o_orderkey", F.round(iso(text), 6).alias("minutes"))


@query("long_episode_ids", """
select doc_id, concat('v_chunk_', case when doc_id * 3000 < 1000 then lpad((doc_id * 3000)::varchar, 4, '0')
  else (doc_id * 3000)::varchar end) as chunk_id,
 concat('v_', case when doc_id * 30000 < 10000 then lpad((doc_id * 30000)::varchar, 5, '0')
  else (doc_id * 30000)::varchar end) as segment_id from documents""")
def long_episode_ids(spark, sf):
    """Ids of windows and segments far into an endless episode stay different."""
    from talkmine.operators.chunking import chunk_id
    from talkmine.operators.staging import with_segment_keys
    far = t.table(spark, sf, "documents").select(
        "doc_id", F.lit("v").alias("video_id"), (F.col("doc_id") * 30_000).alias("segment_index"),
        F.lit(0.0).alias("start_time"), F.lit(1.0).alias("duration_sec"),
        chunk_id(F.lit("v"), F.col("doc_id") * 3000).alias("chunk_id"))
    return with_segment_keys(far).select("doc_id", "chunk_id", "segment_id")


@query("vtt_to_segments", r"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as t,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
 cues as (select doc_id, pos, trim(regexp_replace(t, '<[^>]+>', '', 'g')) as text from lines),
 kept as (select *, lag(text) over (partition by doc_id order by pos) as before from cues where text <> '')
select cast(doc_id as varchar) as file_id, text, pos * 4.0::double as start, 3.5::double as duration from kept
where before is null or before <> text""")
def vtt_to_segments(spark, sf):
    """Documents written as subtitle files, one cue per line, and read back."""
    def clock(sec):
        return F.concat(
            F.lpad(F.floor(sec / 3600).cast("string"), 2, "0"), F.lit(":"),
            F.lpad(F.floor(sec % 3600 / 60).cast("string"), 2, "0"), F.lit(":"),
            F.format_string("%06.3f", sec % 60))

    def cue(line, i):
        return F.concat(clock(i * 4.0), F.lit(" --> "), clock(i * 4.0 + 3.5), F.lit(" align:start\n<c>"), line, F.lit("</c>"))

    body = F.array_join(F.transform(F.split("text", "\n", -1), cue), "\n\n")
    whole = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), body)
    # every third file has the line ends of another system
    ends = F.when(F.col("doc_id") % 3 == 1, F.regexp_replace(whole, "\n", "\r\n")).otherwise(whole)
    subtitles = t.documents(spark, sf).select(F.col("doc_id").cast("string").alias("file_id"), ends.alias("content"))
    return files.vtt_rows(subtitles)


def _file_pairs(spark, sf):
    """Documents as metadata and transcript files, some missing or broken."""
    number = F.col("video_id").cast("long") % 50
    folder = F.concat(F.lit("raw/"), "channel_name", F.lit("/"), "video_id")
    meta = t.metadata(spark, sf)
    bodies = F.to_json(F.struct(*[x for x in meta.columns if x != "genre"]))
    meta_files = meta.select(
        F.concat(folder, F.lit("_metadata.json")).alias("path"),
        F.when(number == 3, "{broken").when(number == 4, F.concat(F.lit("["), bodies, F.lit("]"))).otherwise(bodies)
        .alias("content"))
    texts = t.transcripts(spark, sf).filter(number != 2).select(
        F.concat(F.lit("raw/x/"), "video_id", F.lit("_transcript.json")).alias("path"),
        F.when(number == 1, '{"text": "not a list"}').otherwise(F.to_json("segments")).alias("content"))
    return files.parse_metadata(meta_files), files.parse_transcripts(texts)


@query("load_stats", """
select count(*) as total, count(*) filter (doc_id % 50 not in (1, 2, 3)) as loaded,
 count(*) filter (doc_id % 50 in (1, 2)) as skipped, count(*) filter (doc_id % 50 = 3) as failed,
 count(distinct source) as channels from documents""")
def load_stats(spark, sf):
    return files.quarantine(*_file_pairs(spark, sf))[2]


@query("load_rejects", """
select cast(doc_id as varchar) as file_id, source as folder, case doc_id % 50 when 1 then 'skipped: bad transcript'
 when 2 then 'skipped: no transcript' else 'failed: metadata' end as outcome
from documents where doc_id % 50 in (1, 2, 3)""")
def load_rejects(spark, sf):
    return files.quarantine(*_file_pairs(spark, sf))[1]


@query("merge_payload", sql("""
select video_id, concat(channel_name, '/', video_id) as load_source, segment_count, total_words, duration_covered,
 coverage_pct, artifact_count, gap5 as has_timestamp_gaps, words_per_minute, 'Unknown' as genre
from metrics where cast(video_id as bigint) % 50 not in (1, 2, 3)""", "metrics"))
def merged_payload(spark, sf):
    """Landing rows built from the parsed files."""
    meta, texts = _file_pairs(spark, sf)
    with_genre = meta.filter(~F.col("bad")).withColumn("genre", sel.genre_of(F.concat(F.lit("zz"), "folder")))
    source = F.concat("folder", F.lit("/"), "video_id")
    return merge_payload(with_genre.drop("bad"), texts.drop("bad"), source).select(
        "video_id", "load_source", "segment_count", "total_words", "duration_covered", "coverage_pct",
        "artifact_count", "has_timestamp_gaps", "words_per_minute", "genre")


@query("min_words", sql("""
select video_id, total_words from metrics where total_words >= 100""", "metrics"))
def min_words(spark, sf):
    return sel.min_words(t.payload(spark, sf)).select("video_id", "total_words")


@query("new_items_anti", sql("""
select chunk_id from chunks where video_id not in (select cast(doc_id as varchar) from labels)""", "chunks"))
def new_items_anti(spark, sf):
    return sinks.new_rows(chunks(spark, sf), labelled(spark, sf), "video_id").select("chunk_id")


@query("restrict_to_new", sql("""
select chunk_id from chunks where video_id in (select cast(doc_id as varchar) from labels)""", "chunks"))
def restrict_to_new(spark, sf):
    return chunks(spark, sf).join(labelled(spark, sf), "video_id", "left_semi").select("chunk_id")


@query("upsert_new", """
select concat('UC', source) as channel_id, source as channel_name,
 concat('https://www.youtube.com/channel/UC', source) as youtube_url from documents group by 1, 2, 3
having min(doc_id) > 3""")
def upsert_new(spark, sf):
    """Channels of the first few documents are already in the table."""
    rows = sinks.channel_rows(t.metadata(spark, sf))
    held = sinks.channel_rows(t.metadata(spark, sf).filter(F.col("video_id").cast("long") <= 3))
    return sinks.upsert_new(held, rows, "channel_id").drop("genre")


@query("chunk_coverage", sql("""
select count(distinct c.chunk_id) as total, count(distinct k.chunk_id) as covered,
 round(count(distinct k.chunk_id) * 100.0::double / count(distinct c.chunk_id), 1) as coverage_pct
from chunks c left join claims k on c.chunk_id = k.chunk_id""", "chunks", "claims"))
def chunk_coverage(spark, sf):
    return q.coverage(chunks(spark, sf), t.claims(spark, sf), "chunk_id")


@query("unprocessed_chunks", sql("""
select chunk_id from chunks where chunk_id not in (select chunk_id from claims)
order by video_id, chunk_start_sec, chunk_id limit 20""", "chunks", "claims"))
def unprocessed_chunks(spark, sf):
    return c.unprocessed(chunks(spark, sf), t.claims(spark, sf), "chunk_id", 20).select("chunk_id")


@query("pending_by_channel", sql("""
select channel_name, count(*) as pending from chunks where chunk_id not in (select chunk_id from claims)
group by 1""", "chunks", "claims"))
def pending_by_channel(spark, sf):
    return c.pending_by_channel(chunks(spark, sf), t.claims(spark, sf))


# --- quality -----------------------------------------------------------------------------

@query("dq_nulls", sql("""
select 'null ' || n || ' in chunks' as check_name, v as value, case when v = 0 then 'pass' else 'fail' end as status
from (select 'chunk_id' as n, count(*) filter (chunk_id is null) as v from chunks union all
 select 'chunk_text', count(*) filter (chunk_text is null or trim(chunk_text) = '') from chunks union all
 select 'video_id', count(*) filter (video_id is null) from chunks) x""", "chunks"))
def dq_nulls(spark, sf):
    return q.null_checks(chunks(spark, sf), ["chunk_id", "chunk_text", "video_id"], "chunks")


@query("dq_unique", sql("""
select 'unique chunk_id in chunks' as check_name, count(*) as value, case when count(*) = 0 then 'pass' else 'fail' end
 as status from (select chunk_id from chunks group by 1 having count(*) > 1) x
union all select 'unique text in documents', count(*), case when count(*) = 0 then 'pass' else 'fail' end
from (select text from documents group by 1 having count(*) > 1) y""", "chunks"))
def dq_unique(spark, sf):
    return q.stack(
        q.unique(chunks(spark, sf), ["chunk_id"], "chunks"),
        q.unique(t.table(spark, sf, "documents"), ["text"], "documents"))


@query("dq_refs", sql("""
select n as check_name, v as value, case when v = 0 then 'pass' else 'fail' end as status from (
 select 'claim to chunk' as n, count(*) as v from claims where chunk_id not in (select chunk_id from chunks)
 union all select 'chunk to episode', count(*) from chunks where video_id not in (select video_id from meta)) x""",
                      "chunks", "claims"))
def dq_refs(spark, sf):
    made = chunks(spark, sf)
    return q.stack(
        q.refs(t.claims(spark, sf), made, "chunk_id", "claim to chunk"),
        q.refs(made, t.metadata(spark, sf), "video_id", "chunk to episode"))


@query("dq_embedding_coverage", sql("""
select count(*) as total, count(e.vec_id) as covered, round(count(e.vec_id) * 100.0::double / count(*), 2) as coverage_pct,
 case when count(e.vec_id) * 100.0 / count(*) >= 99 then 'full' when count(e.vec_id) * 100.0 / count(*) >= 90
  then 'partial' else 'low' end as status
from (select distinct video_id from chunks) c left join embeddings e on c.video_id = cast(e.vec_id as varchar)""", "chunks"))
def dq_embedding_coverage(spark, sf):
    vectors = t.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"))
    return q.banded_coverage(chunks(spark, sf), vectors, "video_id")


@query("dq_links", sql("""
select 'link format in chunks' as check_name, count(*) filter (not regexp_matches(youtube_url,
 '^https://www\\.youtube\\.com/watch\\?v=[^&\\s]+&t=[0-9]+s?$')) as value, 'pass' as status from chunks
union all select 'link format in claims', count(*), case when count(*) = 0 then 'pass' else 'fail' end from claims
 where o_bad
union all select 'chunk times ordered', count(*) filter (chunk_end_sec < chunk_start_sec
  or floor(chunk_start_sec / 120) <> w), 'pass' from chunks
union all select 'segment times ordered', v, case when v = 0 then 'pass' else 'fail' end from (
 select count(*) filter (start < before) as v from (
  select start, lag(start) over (partition by video_id order by segment_index) as before from segments) x) y""".replace(
    "from claims\n where o_bad", "from orders where o_orderkey % 10 = 3 and o_custkey in (select c_custkey from customer)"),
  "chunks"))
def dq_links(spark, sf):
    made = chunks(spark, sf)
    return q.stack(
        q.link_format(made, "youtube_url", "chunks"), q.link_format(
            t.claims(spark, sf).withColumn("youtube_url", F.when(
                F.col("claim_id").cast("long") % 10 == 3, "watch?v=broken").otherwise(F.col("youtube_url"))),
            "youtube_url", "claims"), q.times_ordered(made),
        q.segments_ordered(t.episodes(spark, sf)).withColumn("value", F.col("value").cast("long")))


@query("dq_domains", sql("""
select 'values of ' || n as check_name, v as value, case when v = 0 then 'pass' else 'fail' end as status from (
 select 'claim_type' as n, count(*) filter (claim_type not in ('VERIFIABLE_FACT', 'PREDICTION', 'OPINION', 'STATISTICAL')
   or cast(claim_id as bigint) % 11 = 0) as v from claims
 union all select 'sentiment', count(*) filter (sentiment not in ('positive', 'negative', 'neutral')) from claims
 union all select 'speaker_role', count(*) filter (cast(claim_id as bigint) % 13 = 0) from claims
 union all select 'attribution_confidence', count(*) filter (attribution_confidence not in ('HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'))
  from claims
 union all select 'verification_status', count(*) filter (verification_status not in ('PENDING', 'VERIFIED', 'OUTDATED',
  'DISPUTED', 'UNVERIFIED', 'FALSE')) from claims) x""",
                         "claims"))
def dq_domains(spark, sf):
    """Some claims are given a type and a role that no domain holds."""
    key = F.col("claim_id").cast("long")
    return q.claim_domains(t.claims(spark, sf).withColumns({
        "claim_type": F.when(key % 11 == 0, "RUMOUR").otherwise(F.col("claim_type")),
        "speaker_role": F.when(key % 13 == 0, "BYSTANDER").otherwise(F.col("speaker_role"))}))


@query("dq_bands", sql("""
select n as check_name, v as value, case when v > b then 'ok' when v > 0 then 'low' else 'empty' end as status from (
 select 'episodes' as n, count(*) as v, 100 as b from documents union all
 select 'segments', count(*), 1000 from segments union all select 'chunks', count(*), 5000 from chunks) x""",
                       "segments", "chunks"))
def dq_bands(spark, sf):
    from talkmine.operators.staging import flatten_segments
    return q.row_bands({
        "episodes": (t.table(spark, sf, "documents"), 100),
        "segments": (flatten_segments(t.payload(spark, sf)), 1000),
        "chunks": (chunks(spark, sf), 5000)})


@query("dq_density", sql("""
select 'chunks per video' as check_name, round(count(*) / count(distinct video_id), 1) as value,
 case when count(*) / count(distinct video_id) between 20 and 80 then 'ok' else 'check' end as status from chunks""",
                         "chunks"))
def dq_density(spark, sf):
    return q.density_band(chunks(spark, sf))


@query("health", sql("""
select 'episodes' as layer, count(*) as row_count, count(distinct video_id) as unique_videos from meta
union all select 'chunks', count(*), count(distinct video_id) from chunks
union all select 'claims', count(*), count(distinct video_id) from claims""", "chunks", "claims"))
def health(spark, sf):
    return q.health({
        "episodes": t.metadata(spark, sf), "chunks": chunks(spark, sf), "claims": t.claims(spark, sf)})


@query("new_counts", sql("""
select count(*) as new_rows, count(distinct video_id) as new_videos from chunks
where video_id not in (select cast(doc_id as varchar) from labels)""", "chunks"))
def new_counts(spark, sf):
    return q.new_counts(chunks(spark, sf), labelled(spark, sf))


# --- streaming ---------------------------------------------------------------------------

def _stream(spark, sf, name):
    schema = t.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def _refreshed(spark, sf) -> str:
    """Tables after the stream ran twice; the second run finds nothing new."""
    home = fresh_dir(spark, "refresh")
    for run in (1, 2):
        r.run_refresh(_stream(spark, sf, "documents"), f"{home}/tables", f"{home}/checkpoint{run}",
                      lambda docs: t.payload_of(t.spread(docs, "doc_id")))
    return f"{home}/tables"


@query("stream_incremental", sql("""
select chunk_id, segment_count, word_count, length(chunk_text) as chars from chunks""", "chunks"))
def stream_incremental(spark, sf):
    made = spark.read.parquet(f"{_refreshed(spark, sf)}/chunks")
    return made.select("chunk_id", "segment_count", "word_count", F.length("chunk_text").cast("long").alias("chars"))


@query("stream_index_search", sql(_CHUNK_BM25 + """
 select chunk_id, score from bm order by score desc, chunk_id limit 8""", "chunks"))
def stream_index_search(spark, sf):
    """Keyword search over the index that the stream maintains."""
    index, stats = r.read_index(spark, _refreshed(spark, sf), s.query_terms("music more"))
    return s.bm25_topk(index, "music more", 8, index=index, stats=stats)


@query("stream_append_once", """
select event_type, count(*) as events, count(distinct event_id) as ids from events group by 1""")
def stream_append_once(spark, sf):
    """Copies come in later batches than the first, and some first rows come years late."""
    home = fresh_dir(spark, "once")
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_id") % 3 == 0
    for run, rows in enumerate((events.filter(~late), events)):
        r.append_once(rows, f"{home}/events", f"{home}/checkpoint{run}", "event_id")
    return spark.read.parquet(f"{home}/events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@query("stream_dedupe", """
select event_type, count(*) as events, count(distinct event_id) as ids from events group by 1""")
def stream_dedupe(spark, sf):
    """Every event arrives twice and is kept once."""
    home = fresh_dir(spark, "dedupe")
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = r.dedupe_stream(doubled, ["event_id"], "ts").drop("copy")
    once.writeStream.format("parquet").option("path", f"{home}/events").option(
        "checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))
