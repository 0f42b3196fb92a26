"""Participant and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmine.operators import claims
from talkmine.operators import graph as g
from talkmine.operators import participants as p
from talkmine.plans.claims import evolution
from talkmine.plans.oracle import sql
from talkmine.plans.registry import ORACLES, QUERIES, query
from talkmine.plans.transcripts import chunks, day
from talkmine.session import cut_lineage, fresh_dir
from talkmine.sources import files, sinks
from talkmine.sources import tables as t

NAME = r"([A-Z][a-z]+ [A-Z][a-z]+)"
# Title patterns of the four adapted shows: a host to skip, a fall-through, two groups, a solo show.
SHOWS = [
    ("Show 0", ["Ann Stone", "Bob Rivera"], [rf"^{NAME}:", rf" - {NAME}$", r"^(Notes) on (markets)$"]),
    ("Show 1", ["Bob Khan"], [rf"\|\s*{NAME}(?:\s*\([^)]+\))?$", r"^Talk with ([A-Z][a-z]+) ([A-Z][a-z]+)$",
                              r"^Talk with (.+)$"]),
    ("Show 2", ["Eli Sato"], []),
    ("Show 3", ["Dev Lind"], [r"#\d+ - (.+)$", r"^On markets \| (.+)$", r"^(.+): (On markets) \|"]),
]


def _name_sql(pattern: str, group: int) -> str:
    raw = f"regexp_extract(episode_title, '{pattern}', {group})"
    return f"trim(regexp_replace(trim(regexp_replace(trim({raw}), '\\s*\\([^)]+\\)\\s*$', '')), '\\s*\\|.*$', ''))"


def _guest_sql() -> str:
    import re
    cases = []
    for channel, hosts, patterns in SHOWS:
        host_test = " or ".join(f"contains(lower(x), '{h.lower()}')" for h in hosts)
        tries = []
        for pattern in patterns:
            names = ", ".join(_name_sql(pattern, i) for i in range(1, re.compile(pattern).groups + 1))
            tries.append(f"list_filter([{names}], lambda x: not ({host_test}) and regexp_matches(x, '\\S\\s+\\S'))")
        picks = " ".join(f"when len({e}) > 0 then {e}" for e in tries)
        if picks:
            cases.append(f"when channel_name = '{channel}' then (case {picks} else [] end)")
    return f"case {' '.join(cases)} else [] end"


_HOSTS = " union all ".join(
    f"select '{channel}' as channel_name, '{h}' as host" for channel, hosts, _ in SHOWS for h in hosts)
_PEOPLE = f""", guests as (select video_id, channel_name, episode_title, {_guest_sql()} as names from titles),
 people as (
  select distinct on (video_id, participant_name) * from (
   select video_id, host as participant_name, 'HOST' as participant_role, 'MANUAL' as extraction_method,
    'HIGH' as confidence, channel_name from titles join ({_HOSTS}) using (channel_name)
   union all select video_id, unnest(names), 'GUEST', 'TITLE_PARSE', 'HIGH', channel_name from guests) x)"""


def show_episodes(spark, sf):
    return t.titles(spark, sf)


def people(spark, sf):
    return p.participants(show_episodes(spark, sf), p.show_table(spark, SHOWS))


@query("guest_from_title", sql(_PEOPLE + """
select video_id, participant_name, extraction_method, confidence from people
where participant_role = 'GUEST'""", "titles"))
def guest_from_title(spark, sf):
    return p.guests_from_titles(show_episodes(spark, sf), p.show_table(spark, SHOWS)).select(
        "video_id", "participant_name", "extraction_method", "confidence")


@query("participants", sql(_PEOPLE + """
select video_id, participant_name, participant_role, extraction_method, confidence from people""", "titles"))
def participants(spark, sf):
    return people(spark, sf).select(
        "video_id", "participant_name", "participant_role", "extraction_method", "confidence")


def _answers(spark, sf):
    """Customer names as answers about episodes whose title gave no guest."""
    key = F.col("c_custkey")
    return t.table(spark, sf, "customer").select(
        key.cast("string").alias("video_id"),
        F.when(key % 3 == 0, "none").when(key % 3 == 1, F.concat("c_name", F.lit(" | "), "c_mktsegment"))
        .otherwise(" ").alias("raw"))


@query("guest_fallback", sql(_PEOPLE + """
select video_id, unnest([c_name, c_mktsegment]) as participant_name, 'MEDIUM' as confidence
from guests join customer on video_id = cast(c_custkey as varchar)
where len(names) = 0 and channel_name <> 'Show 2' and c_custkey % 3 = 1""", "titles"))
def guest_fallback(spark, sf):
    return p.guests_from_answers(
        show_episodes(spark, sf), p.show_table(spark, SHOWS), _answers(spark, sf)
    ).select("video_id", "participant_name", "confidence")


@query("extraction_stats", sql(_PEOPLE + """
select count(*) as episodes, count(*) filter (len(names) > 0) as regex_hit,
 count(*) filter (len(names) = 0 and channel_name <> 'Show 2' and cast(video_id as bigint) % 3 = 1) as fallback_hit,
 count(*) filter (len(names) = 0 and (channel_name = 'Show 2' or cast(video_id as bigint) % 3 <> 1)) as no_guest
from guests""", "titles"))
def extraction_stats(spark, sf):
    return p.extraction_stats(show_episodes(spark, sf), p.show_table(spark, SHOWS), _answers(spark, sf))


@query("guest_coverage", sql(_PEOPLE + """
select count(distinct video_id) as total_episodes,
 count(distinct case when participant_role = 'GUEST' then video_id end) as episodes_with_guest,
 round(count(distinct case when participant_role = 'GUEST' then video_id end) * 100.0::double
  / count(distinct video_id), 1) as guest_coverage_pct from people""", "titles"))
def guest_coverage(spark, sf):
    return p.guest_coverage(people(spark, sf))


@query("top_participants", sql(_PEOPLE + """
select participant_name, participant_role, count(*) as episode_count from people group by 1, 2
order by 3 desc, 1, 2 limit 20""", "titles"))
def top_participants(spark, sf):
    return p.top_participants(people(spark, sf))


@query("participant_map", sql(_PEOPLE + """
select video_id, coalesce(string_agg(participant_name, ', ' order by participant_name)
  filter (participant_role = 'HOST'), 'Unknown') as hosts,
 coalesce(string_agg(participant_name, ', ' order by participant_name)
  filter (participant_role = 'GUEST'), 'Unknown') as guests from people group by 1""", "titles"))
def participant_map(spark, sf):
    return p.participant_map(people(spark, sf))


@query("chunk_participants", sql(_PEOPLE + """
, named as (select video_id, string_agg(participant_name, ', ' order by participant_name) as guests
  from people where participant_role = 'GUEST' group by 1)
select chunk_id, coalesce(guests, 'Unknown') as guests from chunks left join named using (video_id)""",
                             "titles", "chunks"))
def chunk_participants(spark, sf):
    return p.with_participants(chunks(spark, sf), people(spark, sf)).select("chunk_id", "guests")


def mentions(spark, sf):
    """Spelling variants: ten letters per customer, some mentions with a letter missing or changed."""
    key = F.col("c_custkey")
    name = F.translate(F.substring(F.md5(key.cast("string")), 1, 10), "0123456789", "ghijklmnop")
    base = t.table(spark, sf, "customer").select(key.alias("k"), name.alias("n"))
    missing = base.filter("k % 3 = 0").select(F.concat(F.substring("n", 1, 4), F.expr("substring(n, 6)")).alias("name"))
    changed = base.filter("k % 4 = 1").select(F.concat(F.expr("substring(n, 1, 9)"), F.lit("Z")).alias("name"))
    longer = base.filter("k % 12 = 9").select(F.concat(F.expr("substring(n, 1, 9)"), F.lit("Zz")).alias("name"))
    out = base.select(F.col("n").alias("name"))
    return out.unionAll(out).unionAll(missing).unionAll(changed).unionAll(longer)


@query("entity_resolution", """
with recursive base as (select c_custkey as k, translate(substring(md5(cast(c_custkey as varchar)), 1, 10),
  '0123456789', 'ghijklmnop') as n from customer),
 said as (select n as name from base union all select n from base
  union all select substring(n, 1, 4) || substring(n, 6) from base where k % 3 = 0
  union all select substring(n, 1, 9) || 'Z' from base where k % 4 = 1
  union all select substring(n, 1, 9) || 'Zz' from base where k % 12 = 9),
 spelled as (select name as alias, lower(name) as f, count(*) as mentions from said group by 1, 2),
 near as (select a.f as s, b.f as d from spelled a join spelled b
  on abs(length(a.f) - length(b.f)) <= 1 and levenshtein(a.f, b.f) <= 1),
 reach(s, d) as (select s, d from near union select r.s, n.d from reach r join near n on r.d = n.s),
 comp as (select s as f, min(d) as c from reach group by 1)
select alias, first_value(alias) over (partition by c order by mentions desc, alias) as canonical, mentions
from spelled join comp using (f)""")
def entity_resolution(spark, sf):
    return p.resolve_entities(mentions(spark, sf))


@query("entity_resolution_batches", ORACLES["entity_resolution"])
def entity_resolution_batches(spark, sf):
    """Mentions in three batches, merged into stored components, as if they had come at once."""
    said, held = cut_lineage(mentions(spark, sf)), (None, None)
    batch = F.pmod(F.xxhash64("name"), F.lit(3))
    for i in range(3):
        held = p.more_entities(said.filter(batch == i), *held)
    return p.canonical_names(*held)


@query("episode_detail", sql(_PEOPLE + """
select 'summary' as section, video_id as key, left(string_agg(chunk_text, ' ' order by chunk_start_sec), 3000) as text,
 concat('Episode ', video_id) as detail from chunks where video_id = '42' and w <= 4 group by video_id
union all select 'claim', claim_id, claim_text, verification_status from claims where video_id = '42'
union all select 'participant', participant_name, participant_name, participant_role from people
 where video_id = '42'""", "titles", "chunks", "claims"))
def episode_detail(spark, sf):
    from talkmine.operators.chunking import episode_excerpt
    from talkmine.operators.claims import episode_detail as detail
    summaries = episode_excerpt(chunks(spark, sf)).withColumnRenamed("excerpt", "episode_summary")
    return detail("42", summaries, t.claims(spark, sf), people(spark, sf))


# --- graph -------------------------------------------------------------------------------

def _parts(spark, sf):
    """Chunk heads and participants, stored once as several edge kinds read them; claims; channels."""
    heads = chunks(spark, sf).select(
        "chunk_id", "video_id", "channel_name", "genre", "episode_title", "publish_date", "youtube_url",
        "chunk_start_sec")
    return cut_lineage(heads), cut_lineage(people(spark, sf)), t.claims(spark, sf), t.channels(spark, sf)


def graph_edges(spark, sf, parts=None):
    parts = parts or _parts(spark, sf)
    return g.edges(*parts, evolution(spark, sf))


def graph(spark, sf):
    parts = _parts(spark, sf)
    return g.nodes(*parts), graph_edges(spark, sf, parts)


_GRAPH = _PEOPLE + """,
 eps as (select distinct video_id, channel_name from chunks),
 chan as (select distinct channel_name from meta),
 kinds as (select *, case when upper(trim(speaker)) = 'UNKNOWN' or attribution_confidence = 'UNKNOWN'
   then 'DISCUSSED_IN' when attribution_confidence = 'HIGH' then 'MADE_CLAIM' else 'LIKELY_MADE_CLAIM' end as kind
  from claims),
 nodes as (select 'Channel' as label, channel_name as id from chan union all
  select 'Episode', video_id from eps union all
  select 'Person', name from (select participant_name as name from people union
   select speaker from kinds where kind <> 'DISCUSSED_IN') union all
  select distinct 'Topic', topic from claims union all select 'Claim', claim_id from claims),
 edges as (select 'BELONGS_TO' as type, 'Episode' as src_label, video_id as src, 'Channel' as dst_label,
   channel_name as dst from eps join chan using (channel_name) union all
  select 'APPEARED_ON', 'Person', participant_name, 'Episode', video_id from people
   where video_id in (select video_id from eps) union all
  select kind, 'Person', speaker, 'Claim', claim_id from kinds where kind <> 'DISCUSSED_IN' union all
  select kind, 'Claim', claim_id, 'Episode', video_id from kinds where kind = 'DISCUSSED_IN'
   and video_id in (select video_id from eps) union all
  select 'ABOUT', 'Claim', claim_id, 'Topic', topic from claims union all
  select 'SOURCED_FROM', 'Claim', claim_id, 'Episode', video_id from claims
   where video_id in (select video_id from eps) union all
  select 'EVOLVED_FROM', 'Claim', evolved_claim_id, 'Claim', original_claim_id from evolution)"""
_GRAPH_VIEWS = ("titles", "chunks", "evolution")


@query("graph_nodes", sql(_GRAPH + " select label, id from nodes", *_GRAPH_VIEWS))
def graph_nodes(spark, sf):
    return g.nodes(*_parts(spark, sf))


@query("graph_edges", sql(_GRAPH + " select type, src_label, src, dst_label, dst from edges", *_GRAPH_VIEWS))
def graph_edge_table(spark, sf):
    return graph_edges(spark, sf).select("type", "src_label", "src", "dst_label", "dst")


@query("graph_edge_properties", sql(_PEOPLE + """,
 eps as (select distinct video_id from chunks)
select 'APPEARED_ON' as type, participant_role as role, confidence, extraction_method as method,
 '' as drift_type, count(*) as n from people
 where video_id in (select video_id from eps) group by 1, 2, 3, 4
union all select 'EVOLVED_FROM', '', '', '', drift_type, count(*) from evolution group by drift_type""",
                                *_GRAPH_VIEWS))
def graph_edge_properties(spark, sf):
    return graph_edges(spark, sf).filter("role is not null or drift_type is not null").groupBy(
        "type", "role", "confidence", "method", "drift_type").agg(F.count("*").alias("n")).fillna("")


@query("graph_counts", sql(_GRAPH + """
 select 'node' as part, label as kind, count(*) as count from nodes group by 2
 union all select 'edge', type, count(*) from edges group by 2""", *_GRAPH_VIEWS))
def graph_counts(spark, sf):
    return g.graph_counts(*graph(spark, sf))


@query("episode_nodes", sql("""
select video_id, first(episode_title) as title, first(channel_name) as channel_name,
 strftime(first(publish_date), '%Y-%m-%d') as publish_date, min_by(youtube_url, chunk_start_sec) as youtube_url
from chunks group by 1""", "chunks"))
def episode_nodes(spark, sf):
    return g.episode_nodes(chunks(spark, sf)).drop("genre")


@query("person_nodes", sql(_PEOPLE + """,
 n as (select participant_name as name, participant_role as r, channel_name as c, count(distinct video_id) as n
  from people group by 1, 2, 3),
 best as (select * from n qualify row_number() over (partition by name order by n desc, r, c) = 1),
 said as (select distinct speaker as name from claims where upper(trim(speaker)) <> 'UNKNOWN'
  and attribution_confidence <> 'UNKNOWN')
select coalesce(best.name, said.name) as name, coalesce(r, '') as primary_role, coalesce(c, '') as primary_channel
from best full join said on best.name = said.name""", "titles", "claims"))
def person_nodes(spark, sf):
    return g.person_nodes(people(spark, sf), t.claims(spark, sf)).fillna("")


@query("orphans", sql(_GRAPH + """
 select 'person without episode' as check_name, count(*) as orphans from nodes where label = 'Person'
  and id not in (select src from edges where type = 'APPEARED_ON')
 union all select 'claim without episode', count(*) from nodes where label = 'Claim'
  and id not in (select src from edges where type in ('SOURCED_FROM', 'DISCUSSED_IN'))
 union all select 'claim without topic', count(*) from nodes where label = 'Claim'
  and id not in (select src from edges where type = 'ABOUT')""", *_GRAPH_VIEWS))
def orphans(spark, sf):
    all_nodes, all_edges = graph(spark, sf)
    return g.orphans(cut_lineage(all_nodes), cut_lineage(all_edges))


@query("who_discussed", sql("""
select speaker as person, channel_name as channel, count(*) as claims from claims
where lower(topic) like '%t39%' or lower(claim_text) like '%machinery%'
group by 1, 2 order by 3 desc, 1, 2 limit 25""", "claims"))
def who_discussed(spark, sf):
    return g.who_discussed(t.claims(spark, sf), "T39", "MACHINERY")


@query("channel_topics", sql("""
select topic, count(*) as mentions from claims where lower(channel_name) like '%nation_2%'
group by 1 order by 2 desc, 1 limit 25""", "claims"))
def channel_topics(spark, sf):
    return g.channel_topics(t.claims(spark, sf), "NATION_2")


@query("most_discussed", sql(
    "select topic, count(*) as mentions from claims group by 1 order by 2 desc, 1 limit 25", "claims"))
def most_discussed(spark, sf):
    return g.most_discussed(t.claims(spark, sf))


@query("speaker_claims", sql("""
select topic, claim_text as claim, strftime(claim_date, '%Y-%m-%d') as date, channel_name as channel, claim_id
from claims where lower(speaker) like '%customer#00000002%' order by claim_date desc, claim_id limit 25""", "claims"))
def speaker_claims(spark, sf):
    return g.speaker_claims(t.claims(spark, sf), "Customer#00000002").withColumn("date", day("date"))


@query("most_appearing", sql(_GRAPH + """
 select src as person, count(*) as episodes from edges where type = 'APPEARED_ON'
 group by 1 order by 2 desc, 1 limit 25""", *_GRAPH_VIEWS))
def most_appearing(spark, sf):
    return g.most_appearing(_appeared(spark, sf))


def _heads(spark, sf):
    """Episode and channel of each chunk, stored once."""
    return cut_lineage(chunks(spark, sf).select("video_id", "channel_name").distinct())


def _appeared(spark, sf, heads=None):
    heads = heads or _heads(spark, sf)
    return g.appeared_on(people(spark, sf), heads.select("video_id").distinct())


@query("multi_channel_people", sql(_GRAPH + """
 select person, channel_count, channels from (
 select a.src as person, count(distinct b.dst) as channel_count,
  string_agg(distinct b.dst, ',' order by b.dst) as channels
 from edges a join edges b on a.dst = b.src where a.type = 'APPEARED_ON' and b.type = 'BELONGS_TO' group by 1) x
 where channel_count > 1 order by channel_count desc, person limit 25""", *_GRAPH_VIEWS))
def multi_channel_people(spark, sf):
    heads = _heads(spark, sf)
    belongs = g.belongs_to(heads, t.channels(spark, sf))
    return g.multi_channel_people(_appeared(spark, sf, heads), belongs).withColumn(
        "channels", F.array_join("channels", ","))


@query("co_appearance", sql(_GRAPH + """
 select b.src as person, count(distinct b.dst) as shared_episodes from edges a join edges b
 on a.dst = b.dst and a.type = 'APPEARED_ON' and b.type = 'APPEARED_ON' and a.src <> b.src
 where a.src = 'Dev Lind' group by 1""", *_GRAPH_VIEWS))
def co_appearance(spark, sf):
    return g.co_appearance(cut_lineage(_appeared(spark, sf)), "Dev Lind")


@query("k_hop", sql(_GRAPH + """,
 links as (select src_label || ':' || src as a, dst_label || ':' || dst as b from edges
  union select dst_label || ':' || dst, src_label || ':' || src from edges),
 one as (select distinct b from links where a = 'Person:Dev Lind'),
 two as (select distinct b from links where a in (select b from one)),
 hops as (select 'Person:Dev Lind' as node, 0 as hops union all select b, 1 from one union all select b, 2 from two)
 select split_part(node, ':', 1) as label, substring(node, position(':' in node) + 1) as id, min(hops) as hops
 from hops group by node""", *_GRAPH_VIEWS))
def k_hop(spark, sf):
    return g.k_hop(graph_edges(spark, sf), "Person", "Dev Lind", 2)


@query("k_hop_hub", sql(_GRAPH + """,
 links as (select src_label || ':' || src as a, dst_label || ':' || dst as b from edges union
  select dst_label || ':' || dst, src_label || ':' || src from edges),
 one as (select distinct b from links where a = 'Channel:src1'),
 two as (select distinct links.b from links join one on links.a = one.b),
 hops as (select 'Channel:src1' as node, 0 as hops union all select b, 1 from one union all select b, 2 from two)
select split_part(node, ':', 1) as label, substring(node, position(':' in node) + 1) as id, min(hops) as hops
from hops group by node""", *_GRAPH_VIEWS))
def k_hop_hub(spark, sf):
    """From a channel, a node with many edges, whose neighbours lie in several lists."""
    all_edges = cut_lineage(graph_edges(spark, sf))
    return g.k_hop(all_edges, "Channel", "src1", 2, cut_lineage(g.adjacency(all_edges, 16)))


# --- sinks ---------------------------------------------------------------------------------

_KIND_COUNTS = """
select 'edge' as part, type as kind, count(*) as count from edges group by 2
union all select 'node', label, count(*) from nodes group by 2"""


def _stored_counts(spark, path):
    made = [spark.read.parquet(f"{path}/{name}").groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("count")).select(
        F.lit(part).alias("part"), "kind", "count") for name, part, kind in (("edges", "edge", "type"), ("nodes", "node", "label"))]
    return made[0].unionByName(made[1])


def _graph_tables(spark, sf):
    all_nodes, all_edges = (cut_lineage(x) for x in graph(spark, sf))
    return all_nodes, all_edges.select("type", "src_label", "src", "dst_label", "dst").distinct()


@query("graph_export", sql(_GRAPH + _KIND_COUNTS, *_GRAPH_VIEWS))
def graph_export(spark, sf):
    """Nodes and edges written in two overlapping parts, each key once."""
    all_nodes, all_edges = _graph_tables(spark, sf)
    path = fresh_dir(spark, "graph")
    sinks.write_graph(all_nodes.filter(F.xxhash64("id") % 2 == 0), all_edges.filter(F.xxhash64("src") % 2 == 0), path)
    sinks.write_graph(all_nodes, all_edges, path, "append")
    return _stored_counts(spark, path)


@query("graph_reload", sql(_GRAPH + _KIND_COUNTS, *_GRAPH_VIEWS))
def graph_reload(spark, sf):
    """A reload leaves nothing of what was there before."""
    all_nodes, all_edges = _graph_tables(spark, sf)
    path = fresh_dir(spark, "graph")
    sinks.write_graph(all_nodes.withColumn("id", F.concat(F.lit("old "), "id")), all_edges.limit(5), path)
    sinks.write_graph(all_nodes, all_edges, path)
    return _stored_counts(spark, path)


@query("stored_claims", sql("""
select topic, count(*) as claims, min(claim_id) as first_claim,
 (select count(distinct video_id) from claims) as chunks_answered from claims group by 1""", "claims"))
def stored_claims(spark, sf):
    """Claims stored in two overlapping batches; answered chunks are noted once."""
    rows, path = t.claims(spark, sf), fresh_dir(spark, "claims")
    for part in (rows.filter(F.xxhash64("claim_id") % 3 != 0), rows):
        sinks.store_claims(part, part.select("chunk_id"), path)
    answered = spark.read.parquet(f"{path}/processed_chunks").agg(F.count("*")).scalar()
    return spark.read.parquet(f"{path}/claims").groupBy("topic").agg(
        F.count("*").alias("claims"), F.min("claim_id").alias("first_claim")).withColumn("chunks_answered", answered)


@query("search_log", sql("""
select query_type, count(*) as searches, cast(sum(latency_ms) as bigint) as latency from search_history group by 1""",
                         "search_history"))
def search_log(spark, sf):
    """The search history appended in two parts."""
    rows, path = t.search_history(spark, sf), fresh_dir(spark, "log")
    for part in (0, 1):
        sinks.append_log(rows.filter(F.col("search_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("query_type").agg(
        F.count("*").alias("searches"), F.sum("latency_ms").alias("latency"))


@query("profile_report", ORACLES["genre_breakdown"])
def profile_report(spark, sf):
    """A profile stored as a report and read again; a second report takes its place."""
    rows, path = QUERIES["genre_breakdown"](spark, sf), fresh_dir(spark, "report")
    sinks.write_report(rows.limit(1), path, "json")
    sinks.write_report(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("loaded_episodes", sql("""
select channel_name, count(*) as episodes, min(video_id) as first_id, cast(sum(segment_count) as bigint) as segments
from metrics group by 1""", "metrics"))
def loaded_episodes(spark, sf):
    """Landing rows loaded twice, half of them first."""
    rows, path = cut_lineage(t.payload(spark, sf)), fresh_dir(spark, "landing")
    for part in (rows.filter(F.xxhash64("video_id") % 2 == 0), rows, rows):
        sinks.load_episodes(part, path)
    return spark.read.parquet(path).groupBy("channel_name").agg(
        F.count("*").alias("episodes"), F.min("video_id").alias("first_id"), F.sum("segment_count").alias("segments"))


@query("pending_channels", """
with wanted as (select source as name, 60 as target from documents group by 1),
 held as (select source as name, count(distinct doc_id) as done from documents
  where doc_id in (select doc_id from labels) and source <> 'src3' group by 1)
select name, target - coalesce(done, 0) as remaining from wanted left join held using (name)
where target - coalesce(done, 0) > 0""")
def pending_channels(spark, sf):
    """What the channel list still asks for after the ledger, both read from their JSON files."""
    docs, home = t.table(spark, sf, "documents").select("doc_id", "source"), fresh_dir(spark, "config")
    listed = docs.select("source").distinct().agg(F.collect_list(F.struct(
        F.col("source").alias("name"), F.lit(60).alias("target_episodes"))).alias("channels"))
    listed.write.json(f"{home}/channels")
    held = docs.join(t.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").filter("source <> 'src3'")
    state = held.groupBy("source").agg(F.struct(F.collect_list(F.col("doc_id").cast("string")).alias("downloaded_ids")).alias("s"))
    state.agg(F.map_from_entries(F.collect_list(F.struct("source", "s"))).alias("channels")).write.json(f"{home}/ledger")
    left = files.pending(files.read_channels(spark, f"{home}/channels"), files.read_ledger(spark, f"{home}/ledger"))
    return left.select("name", "remaining")


@query("spread_claim_jobs", sql("""
select channel_name, count(*) as chunks, true as several_tasks from chunks group by 1""", "chunks"))
def spread_claim_jobs(spark, sf):
    """Every chunk is a job once, and the jobs are many tasks."""
    jobs = cut_lineage(claims.spread_jobs(chunks(spark, sf).select("chunk_id", "channel_name"), 8).withColumn(
        "task", F.spark_partition_id()))
    tasks = jobs.agg(F.count_distinct("task") > 1).scalar()
    return jobs.groupBy("channel_name").agg(F.count("*").alias("chunks")).withColumn("several_tasks", tasks)


@query("prompts_with_participants", sql(_PEOPLE + """,
 named as (select video_id,
  coalesce(nullif(string_agg(distinct participant_name, ', ' order by participant_name) filter (participant_role = 'HOST'), ''), 'Unknown') as hosts,
  coalesce(nullif(string_agg(distinct participant_name, ', ' order by participant_name) filter (participant_role = 'GUEST'), ''), 'Unknown') as guests
  from people where confidence in ('HIGH', 'MEDIUM') group by 1)
select chunk_id, 'claims' as kind, concat('hosts: ', coalesce(hosts, 'Unknown')) as host_line,
 concat('guests: ', coalesce(guests, 'Unknown')) as guest_line, md5(regexp_replace(chunk_text, '[ \t\n\r]+', '', 'g')) as covered
from chunks left join named using (video_id)""", "titles", "chunks"))
def prompts_with_participants(spark, sf):
    """Claim prompts name who speaks, and show all of the chunk."""
    rows = p.with_participants(chunks(spark, sf), people(spark, sf))
    made = claims.build_prompts(rows, "claims", context=["hosts", "guests"])
    lines = F.split("prompt", "\n", 4)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "part", F.substr(F.get(lines, F.lit(3)), F.lit(len("text: ") + 1)).alias("t")))), lambda x: x["t"]), "")
    return made.groupBy("chunk_id", "kind").agg(
        F.min(F.get(lines, F.lit(1))).alias("host_line"), F.min(F.get(lines, F.lit(2))).alias("guest_line"),
        F.md5(F.regexp_replace(whole, "[ \t\n\r]+", "")).alias("covered"))


@query("entity_and_summary_prompts", sql("""
select chunk_id as id, 'entities' as kind, cast(1 as bigint) as first_part from chunks
union all select video_id, 'summary', 1 from chunks group by video_id""", "chunks"))
def entity_and_summary_prompts(spark, sf):
    """Prompts for the entities of every chunk and the summary of every episode's beginning."""
    from talkmine.operators.chunking import episode_excerpt
    rows = chunks(spark, sf)
    made = claims.build_prompts(rows, "entities").withColumnRenamed("chunk_id", "id").unionByName(
        claims.build_prompts(episode_excerpt(rows), "summary", "video_id", "excerpt").withColumnRenamed("video_id", "id"))
    return made.groupBy("id", "kind").agg(F.min("part").cast("long").alias("first_part"))
