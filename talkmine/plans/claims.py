"""Claim and claim-evolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmine.operators import claims as c
from talkmine.operators import evolution as ev
from talkmine.plans.oracle import sql
from talkmine.plans.registry import query
from talkmine.plans.transcripts import chunks, day
from talkmine.sources import tables as t


def evolution(spark, sf):
    """Topic pairs with a drift type derived from the two ids."""
    kinds = F.array(*[F.lit(d) for d in ("REVISED", "ESCALATED", "SOFTENED", "CONTRADICTED", "CONFIRMED")])
    number = (F.col("original_claim_id").cast("long") + F.col("evolved_claim_id").cast("long")) % 5
    return ev.topic_pairs(t.claims(spark, sf)).withColumn("drift_type", F.get(kinds, number.cast("int")))


@query("top_topics", sql("""
select topic, count(*) as claim_count, count(distinct speaker) as speaker_count,
 count(distinct channel_name) as channel_count from claims where topic is not null and trim(topic) <> ''
group by 1 order by claim_count desc, topic limit 15""", "claims"))
def top_topics(spark, sf):
    return c.top_topics(t.claims(spark, sf))


@query("top_topics_of_speaker", sql("""
select topic, count(*) as claim_count, count(distinct speaker) as speaker_count,
 count(distinct channel_name) as channel_count from claims where lower(speaker) like '%customer#00000000%'
group by 1 order by claim_count desc, topic limit 15""", "claims"))
def top_topics_of_speaker(spark, sf):
    return c.top_topics(t.claims(spark, sf), speaker="Customer#00000000")


@query("channel_report", sql("""
select claim_type, count(*) as cnt, count(distinct speaker) as speakers, count(distinct topic) as topics
from claims where lower(channel_name) like '%nation_1%' group by 1""", "claims"))
def channel_report(spark, sf):
    return c.channel_report(t.claims(spark, sf), "Nation_1")


@query("top_speakers", sql("""
select speaker, count(*) as claim_count, count(distinct topic) as topic_count,
 count(*) filter (claim_type = 'PREDICTION') as predictions,
 count(*) filter (claim_type = 'STATISTICAL') as stats
from claims where upper(trim(speaker)) <> 'UNKNOWN' group by 1 order by claim_count desc, speaker limit 15""",
                     "claims"))
def top_speakers(spark, sf):
    return c.top_speakers(t.claims(spark, sf))


def _compare_sql(column: str, a: str, b: str, topic: str | None) -> str:
    narrow = f"and lower(topic) like '%{topic}%'" if topic else ""
    return sql(" union all ".join(f"""
select * from (select '{side}' as side, claim_id, claim_text, claim_type, topic,
 strftime(claim_date, '%Y-%m-%d') as claim_date, youtube_url, channel_name, speaker from claims
 where lower({column}) like '%{who}%' {narrow} and length(claim_text) > 30
 order by claim_date desc, claim_id limit 15)""" for side, who in (("a", a), ("b", b))), "claims")


@query("compare_speakers", _compare_sql("speaker", "customer#000000007", "customer#000000011", None))
def compare_speakers(spark, sf):
    return c.compare(t.claims(spark, sf), "Customer#000000007", "Customer#000000011").withColumn(
        "claim_date", day("claim_date"))


@query("compare_channels", _compare_sql("channel_name", "nation_3", "nation_7", "t1"))
def compare_channels(spark, sf):
    return c.compare(t.claims(spark, sf), "Nation_3", "Nation_7", topic="T1", by="channel").withColumn(
        "claim_date", day("claim_date"))


_RECOMMEND = """
select episode_title, channel_name, strftime(publish_date, '%Y-%m-%d') as publish_date, {link}, chunk_count
from (select c.episode_title, c.channel_name, c.publish_date, c.{link}, count(*) as chunk_count
 from chunks c {join} where episode_title is not null {where} group by 1, 2, 3, 4)
order by {order}, {link} limit 10"""


def _recommend(spark, sf, **by):
    found = c.recommend(chunks(spark, sf), t.claims(spark, sf), **by)
    return found.withColumn("publish_date", day("publish_date"))


@query("recommend_by_guest", sql(_RECOMMEND.format(
    link="youtube_url", join="join claims k on c.chunk_id = k.chunk_id",
    where="and lower(k.speaker) like '%customer#0000000%'", order="chunk_count desc"), "chunks", "claims"))
def recommend_by_guest(spark, sf):
    return _recommend(spark, sf, guest="Customer#0000000")


@query("recommend_by_topic", sql(_RECOMMEND.format(
    link="video_id", join="join claims k on c.chunk_id = k.chunk_id",
    where="and lower(k.topic) like '%t2%'", order="chunk_count desc"), "chunks", "claims"))
def recommend_by_topic(spark, sf):
    return _recommend(spark, sf, topic="T2", grain="episode")


@query("recommend_by_channel", sql(_RECOMMEND.format(
    link="youtube_url", join="", where="and lower(c.channel_name) like '%src7%'",
    order="publish_date desc"), "chunks"))
def recommend_by_channel(spark, sf):
    return _recommend(spark, sf, channel="src7")


@query("recommend_recent", sql(_RECOMMEND.format(
    link="video_id", join="", where="", order="publish_date desc"), "chunks"))
def recommend_recent(spark, sf):
    return _recommend(spark, sf, grain="episode")


@query("claim_type_share", sql("""
select claim_type, count(*) as count, round(count(*) * 100.0::double / sum(count(*)) over (), 1) as pct
from claims group by 1""", "claims"))
def claim_type_share(spark, sf):
    return c.claim_type_share(t.claims(spark, sf))


@query("confidence_dist", sql(
    "select attribution_confidence, count(*) as count from claims group by 1", "claims"))
def confidence_dist(spark, sf):
    return c.value_counts(t.claims(spark, sf), "attribution_confidence")


@query("status_breakdown", sql(
    "select verification_status, count(*) as count from claims group by 1", "claims"))
def status_breakdown(spark, sf):
    return c.value_counts(t.claims(spark, sf), "verification_status")


@query("factcheck_queue", sql("""
select claim_type, count(*) as pending_fact_check_count from claims
where claim_type in ('VERIFIABLE_FACT', 'STATISTICAL') and verification_status = 'PENDING' group by 1""", "claims"))
def factcheck_queue(spark, sf):
    return c.factcheck_queue(t.claims(spark, sf)).groupBy("claim_type").agg(
        F.count("*").alias("pending_fact_check_count"))


@query("claims_per_channel", sql("""
select channel_name, count(*) as claim_count, count(distinct video_id) as episode_count,
 round(count(*) * 1.0::double / count(distinct video_id), 1) as avg_claims_per_episode
from claims group by 1""", "claims"))
def claims_per_channel(spark, sf):
    return c.claims_per_channel(t.claims(spark, sf))


@query("claim_summary", sql("""
select count(*) as total_claims, count(distinct video_id) as episodes_covered,
 count(distinct chunk_id) as chunks_covered,
 count(*) filter (claim_type = 'VERIFIABLE_FACT') as verifiable,
 count(*) filter (claim_type = 'PREDICTION') as predictions,
 count(*) filter (claim_type = 'OPINION') as opinions,
 count(*) filter (claim_type = 'STATISTICAL') as statistical,
 count(*) filter (attribution_confidence = 'HIGH') as high_conf,
 count(*) filter (attribution_confidence = 'MEDIUM') as med_conf,
 count(*) filter (speaker <> 'Unknown') as attributed_claims from claims""", "claims"))
def claim_summary(spark, sf):
    return c.claim_summary(t.claims(spark, sf))


@query("credibility", sql("""
select channel_name, count(*) as checked,
 round(count(*) filter (verification_status = 'VERIFIED') * 100.0::double / count(*), 2) as verified_pct,
 round(count(*) filter (verification_status = 'OUTDATED') * 100.0::double / count(*), 2) as outdated_pct,
 round(count(*) filter (verification_status = 'FALSE') * 100.0::double / count(*), 2) as false_pct
from claims where verification_status <> 'PENDING' group by 1""", "claims"))
def credibility(spark, sf):
    return c.credibility(t.claims(spark, sf))


@query("topic_channel_heatmap", sql(
    "select topic, channel_name, count(*) as claims from claims group by 1, 2", "claims"))
def topic_channel_heatmap(spark, sf):
    return c.topic_channel_heatmap(t.claims(spark, sf))


@query("topic_channel_pivot", sql("""
select topic, count(*) filter (channel_name = 'NATION_3') as "NATION_3",
 count(*) filter (channel_name = 'NATION_7') as "NATION_7",
 count(*) filter (channel_name = 'NATION_9') as "NATION_9" from claims group by 1""", "claims"))
def topic_channel_pivot(spark, sf):
    return c.topic_channel_heatmap(t.claims(spark, sf), ["NATION_3", "NATION_7", "NATION_9"])


@query("channel_date_span", sql("""
select channel_name, strftime(min(claim_date), '%Y-%m-%d') as first_date,
 strftime(max(claim_date), '%Y-%m-%d') as last_date, count(*) as episodes from claims group by 1""", "claims"))
def channel_date_span(spark, sf):
    return c.date_span(t.claims(spark, sf)).select(
        "channel_name", day("first_date"), day("last_date"), "episodes")


@query("verdict_merge", sql("""
, verdicts as (select cast(l_orderkey as varchar) as claim_id, l_shipdate as seen,
  case l_returnflag when 'R' then 'FALSE' when 'A' then 'VERIFIED' else 'UNVERIFIED' end as status from lineitem),
 latest as (select claim_id, status, seen from verdicts
  qualify row_number() over (partition by claim_id order by seen desc, status desc) = 1)
select claim_id, coalesce(l.status, verification_status) as verification_status,
 coalesce(strftime(l.seen, '%Y-%m-%d'), '') as last_verified from claims left join latest l using (claim_id)""", "claims"))
def verdict_merge(spark, sf):
    """Line items play the results of fact checks; the order is the claim."""
    flag = F.col("l_returnflag")
    verdicts = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("claim_id"),
        F.when(flag == "R", "FALSE").when(flag == "A", "VERIFIED").otherwise("UNVERIFIED")
        .alias("verification_status"),
        F.col("l_shipdate").alias("last_verified"))
    return c.apply_verdicts(t.claims(spark, sf), verdicts).select(
        "claim_id", "verification_status", day("last_verified")).fillna("")


@query("parse_claims", sql("""
select chunk_id, sha256(concat(chunk_id, claim_text)) as claim_id, claim_text, topic, claim_type, sentiment,
 speaker, 'UNKNOWN' as speaker_role, 'UNKNOWN' as attribution_confidence from (
 select chunk_id, concat('Claim ', prompt_id, ' is long enough') as claim_text, 't' as topic,
  case o_orderkey % 3 when 0 then 'PREDICTION' else 'OPINION' end as claim_type, 'neutral' as sentiment,
  case o_custkey % 5 when 0 then 'Unknown' else concat('P', cast(o_custkey as varchar)) end as speaker
 from responses where o_orderkey % 4 <> 3) x""", "responses"))
def parse_claims(spark, sf):
    return c.sanitize_claims(c.parse_claims(t.responses(spark, sf))).select(
        "chunk_id", "claim_id", "claim_text", "topic", "claim_type", "sentiment", "speaker",
        "speaker_role", "attribution_confidence")


@query("parse_claims_stats", """
select count(*) filter (o_orderkey % 4 = 3) as unparsable, count(*) as responses from orders""")
def parse_claims_stats(spark, sf):
    """How many answers gave nothing usable."""
    answers = t.responses(spark, sf)
    good = c.parse_claims(answers).select("prompt_id").distinct()
    bad = c.unprocessed(answers, good, "prompt_id")
    return answers.agg(F.count("*").alias("responses")).select(
        bad.agg(F.count("*")).scalar().alias("unparsable"), "responses")


@query("parse_topics", """
select cast(doc_id as varchar) as chunk_id, source as topic from documents
union all select cast(doc_id as varchar), lang from documents""")
def parse_topics(spark, sf):
    raw = F.concat(F.lit('Sure!\n```json\n["'), "source", F.lit('", "'), "lang", F.lit('", " "]\n```'))
    answers = t.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), raw.alias("topics_raw"))
    return c.parse_topics(answers)


@query("parse_entities", """
select cast(c_custkey as varchar) as chunk_id, 'PERSON' as entity_type, c_name as entity from customer
union all select cast(c_custkey as varchar), 'ORGANIZATION', c_mktsegment from customer""")
def parse_entities(spark, sf):
    raw = F.concat(
        F.lit('{"people": ["'), "c_name", F.lit('"], "organizations": ["'), "c_mktsegment", F.lit('"]}'))
    answers = t.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("chunk_id"), raw.alias("entities_raw"))
    return c.parse_entities(answers)


@query("parse_drift", """
select cast(c_custkey as varchar) as evolution_id,
 case when c_custkey % 5 = 1 then 'CONFIRMED' else 'REVISED' end as drift_type,
 concat('because ', c_name) as analysis from customer where c_custkey % 5 <> 2""")
def parse_drift(spark, sf):
    key = F.col("c_custkey")
    kind = F.when(key % 5 == 1, "unheard of").otherwise("revised ")
    body = F.concat(F.lit('{"drift_type": "'), kind, F.lit('", "analysis": "because '), "c_name", F.lit('"}'))
    raw = (
        F.when(key % 5 == 2, F.concat(body, F.lit("}{")))
        .when(key % 5 == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(key % 5 == 4, F.concat(F.lit("\n\n```json\n"), body, F.lit("\n```\n"))).otherwise(body))
    return ev.parse_drift(t.table(spark, sf, "customer").select(
        key.cast("string").alias("evolution_id"), raw.alias("raw")))


@query("claim_prompts", sql("""
select chunk_id, 'topics' as kind, md5(regexp_replace(chunk_text, '[ \t\n\r]+', '', 'g')) as covered from chunks""", "chunks"))
def claim_prompts(spark, sf):
    """What the prompts of a chunk show together: every character but the blanks they are cut at."""
    made = c.build_prompts(chunks(spark, sf), "topics")
    shown = F.substr("prompt", F.lit(len(c.INSTRUCTIONS["topics"]) + len("\ntext: ") + 1))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", shown.alias("t")))), lambda p: p["t"]), "")
    return made.groupBy("chunk_id", "kind").agg(F.md5(F.regexp_replace(whole, "[ \t\n\r]+", "")).alias("covered"))


@query("search_history_stats", sql("""
select query_type, count(*) as searches, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_search,
 quantile_disc(latency_ms, 0.95) as p95_latency_ms, max(latency_ms) as max_latency_ms
from search_history group by 1""", "search_history"))
def search_history_stats(spark, sf):
    return c.search_stats(t.search_history(spark, sf)).withColumn(
        "last_search", F.date_format("last_search", "yyyy-MM-dd HH:mm:ss"))


@query("recent_searches", sql("""
select search_id, query_type from search_history order by created_at desc, search_id desc limit 20""",
                        "search_history"))
def recent_searches(spark, sf):
    return c.recent_searches(t.search_history(spark, sf)).select("search_id", "query_type")


# --- evolution ---------------------------------------------------------------------------

PAIR_COLUMNS = [
    "evolution_id", "original_claim_id", "evolved_claim_id", "same_speaker", "time_delta_days", "topic",
    "original_speaker", "evolved_speaker", "channel_original", "channel_evolved",
]


@query("topic_pairs", sql(
    f"select {', '.join(PAIR_COLUMNS)}, claim_count from evolution", "evolution"))
def topic_pairs(spark, sf):
    return ev.topic_pairs(t.claims(spark, sf)).select(*PAIR_COLUMNS, "claim_count")


@query("topic_pairs_budget", sql("""
select evolution_id, topic, claim_count from evolution order by claim_count desc, topic limit 50""", "evolution"))
def topic_pairs_budget(spark, sf):
    return ev.topic_pairs(t.claims(spark, sf), max_topics=50).select("evolution_id", "topic", "claim_count")


@query("topic_pairs_budget_new", sql("""
select evolution_id, topic, claim_count from evolution where drift_type <> 'REVISED'
order by claim_count desc, topic limit 50""", "evolution"))
def topic_pairs_budget_new(spark, sf):
    """The budget is spent on pairs that aren't stored yet."""
    stored = evolution(spark, sf).filter("drift_type = 'REVISED'").select("evolution_id")
    return ev.topic_pairs(t.claims(spark, sf), max_topics=50, done=stored).select("evolution_id", "topic", "claim_count")


@query("topic_pairs_new", sql("""
select evolution_id from evolution where drift_type <> 'REVISED'""", "evolution"))
def topic_pairs_new(spark, sf):
    """Pairs not yet stored; those of one drift type count as stored."""
    stored = evolution(spark, sf).filter("drift_type = 'REVISED'").select("evolution_id")
    return ev.topic_pairs(t.claims(spark, sf), done=stored).select("evolution_id")


@query("drift_rules", sql(r"""
, w as (select evolution_id, same_speaker,
  list_filter(string_split_regex(lower(original_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as a,
  list_filter(string_split_regex(lower(evolved_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as b from evolution),
 n as (select *, len(list_filter(a, lambda x: x in ('always','certainly','definitely','clearly','will','must','undoubtedly','every')))
   - len(list_filter(a, lambda x: x in ('maybe','might','could','perhaps','possibly','probably','somewhat','may'))) as fa,
  len(list_filter(b, lambda x: x in ('always','certainly','definitely','clearly','will','must','undoubtedly','every')))
   - len(list_filter(b, lambda x: x in ('maybe','might','could','perhaps','possibly','probably','somewhat','may'))) as fb,
  len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as overlap from w)
select evolution_id, round(overlap, 6) as overlap,
 case when (len(list_filter(a, lambda x: x in ('not','no','never','none','cannot','without','isn','won','don','doesn','didn'))) > 0)
   <> (len(list_filter(b, lambda x: x in ('not','no','never','none','cannot','without','isn','won','don','doesn','didn'))) > 0)
  then 'CONTRADICTED' when fb < fa then 'SOFTENED' when fb > fa then 'ESCALATED'
 when same_speaker and overlap < 0.5 then 'REVISED' else 'CONFIRMED' end as drift_type from n""", "evolution"))
def drift_rules(spark, sf):
    return ev.drift_rules(ev.topic_pairs(t.claims(spark, sf))).select("evolution_id", "overlap", "drift_type")


_COUNTS = ", ".join(
    f"count(*) filter (drift_type = '{d}') as {d.lower()}"
    for d in ("REVISED", "ESCALATED", "SOFTENED", "CONTRADICTED", "CONFIRMED"))


@query("evolution_summary", sql(
    f"select count(*) as total, count(distinct topic) as topics, {_COUNTS} from evolution", "evolution"))
def evolution_summary(spark, sf):
    return ev.evolution_summary(evolution(spark, sf))


@query("drift_summary", sql("""
select drift_type, count(*) as count, round(avg(time_delta_days), 4) as avg_days_apart
from evolution group by 1""", "evolution"))
def drift_summary(spark, sf):
    return ev.drift_summary(evolution(spark, sf))


@query("cross_channel", sql("""
select channel_original, channel_evolved, drift_type, count(*) as count from evolution
where channel_original <> channel_evolved group by 1, 2, 3""", "evolution"))
def cross_channel(spark, sf):
    return ev.cross_channel(evolution(spark, sf))


@query("most_evolved_topics", sql("""
select topic, count(*) as evolution_count, count(*) filter (drift_type = 'CONTRADICTED') as contradictions,
 count(*) filter (drift_type = 'CONFIRMED') as confirmations from evolution
group by 1 order by evolution_count desc, topic limit 20""", "evolution"))
def most_evolved_topics(spark, sf):
    return ev.most_evolved_topics(evolution(spark, sf))


@query("mind_changers", sql("""
select original_speaker, count(*) as total_evolutions,
 count(*) filter (drift_type in ('REVISED', 'SOFTENED')) as changed_mind_count from evolution
where same_speaker group by 1 order by changed_mind_count desc, original_speaker limit 10""", "evolution"))
def mind_changers(spark, sf):
    return ev.mind_changers(evolution(spark, sf))


@query("drift_by_channel", sql(f"""
select channel_original as channel, count(*) as total_evolutions, {_COUNTS} from evolution
group by 1 order by contradicted desc, channel limit 10""", "evolution"))
def drift_by_channel(spark, sf):
    return ev.channel_drift(evolution(spark, sf))


@query("most_debated", sql("""
select topic, count(*) as evolution_count, count(*) filter (drift_type = 'CONTRADICTED') as contradictions,
 count(distinct original_speaker) + count(distinct evolved_speaker) as speakers_involved
from evolution group by 1 order by contradictions desc, topic limit 10""", "evolution"))
def most_debated(spark, sf):
    return ev.most_debated(evolution(spark, sf))


def _lookup_sql(where: str) -> str:
    return sql(f"""
select evolution_id, drift_type, time_delta_days, topic, original_text, evolved_text,
 strftime(original_date, '%Y-%m-%d') as original_date from evolution
where {where} order by time_delta_days desc, evolution_id limit 10""", "evolution")


def _lookup(spark, sf, **by):
    return ev.evolution_lookup(evolution(spark, sf), t.claims(spark, sf), **by).select(
        "evolution_id", "drift_type", "time_delta_days", "topic", "original_text", "evolved_text",
        day("original_date"))


@query("evolution_by_speaker", _lookup_sql(
    "lower(original_speaker) like '%customer#00000001%' or lower(evolved_speaker) like '%customer#00000001%'"))
def evolution_by_speaker(spark, sf):
    return _lookup(spark, sf, speaker="Customer#00000001")


@query("evolution_by_topic", _lookup_sql("lower(topic) like '%t1%'"))
def evolution_by_topic(spark, sf):
    return _lookup(spark, sf, topic="T1")


@query("evolution_by_drift", _lookup_sql("drift_type = 'SOFTENED'"))
def evolution_by_drift(spark, sf):
    return _lookup(spark, sf, drift="softened")


@query("evolution_widest", _lookup_sql("true"))
def evolution_widest(spark, sf):
    return _lookup(spark, sf)
