"""Enrichment and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmine.operators import enrichment as en
from talkmine.operators import search as s
from talkmine.operators.staging import narrowed, refine, with_topic
from talkmine.plans.oracle import sql
from talkmine.plans.registry import query
from talkmine.plans.transcripts import chunks, day
from talkmine.sources import tables as t

_TOKENS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= {1})"


def _postings(least: int) -> str:
    return f""", words as (select chunk_id, video_id, w, unnest({_TOKENS.format('chunk_text', least)}) as term from chunks),
 posts as (select term, chunk_id, count(*) as tf from words group by 1, 2),
 weights as (select term, count(*) as df, ln((select count(*) from chunks) / count(*)) as idf from posts group by 1)"""


@query("tfidf_topics", sql(_postings(4) + """
select chunk_id, term as topic, tf, round(tf * idf, 6) as score,
 row_number() over (partition by chunk_id order by round(tf * idf, 6) desc, term) as rank
from posts join weights using (term) qualify rank <= 5""", "chunks"))
def tfidf_topics(spark, sf):
    return en.tfidf_topics(chunks(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("cap_entities", sql("""
select chunk_id, entity, count(*) as mentions from (
 select chunk_id, unnest(regexp_extract_all(chunk_text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)+')) as entity from chunks) x
group by 1, 2""", "chunks"))
def cap_entities(spark, sf):
    return en.cap_entities(chunks(spark, sf))


@query("top_entities", sql("""
select entity, cast(sum(n) as bigint) as mentions, count(*) as chunks from (
 select chunk_id, entity, count(*) as n from (
  select chunk_id, unnest(regexp_extract_all(chunk_text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)+')) as entity from chunks) x
 group by 1, 2) y group by 1 order by mentions desc, entity limit 25""", "chunks"))
def top_entities(spark, sf):
    return en.top_entities(en.cap_entities(chunks(spark, sf)))


@query("extract_summary", sql(_postings(3) + f"""
, pieces as (select video_id, w, unnest(p) as raw, generate_subscripts(p, 1) as raw_pos from (
  select video_id, w, regexp_extract_all(chunk_text, '[^.!?]+[.!?]*') as p from chunks) x),
 sentences as (select video_id, w, row_number() over (partition by video_id, w order by raw_pos) as pos,
  trim(raw) as sentence from pieces where trim(raw) <> ''),
 listed as (select *, {_TOKENS.format('sentence', 3)} as words from sentences),
 terms as (select video_id, w, pos, unnest(words) as term from listed where len(words) >= 5),
 scored as (select video_id, w, pos, round(avg(idf), 6) as score from terms join weights using (term) group by 1, 2, 3),
 best as (select *, row_number() over (partition by video_id order by score desc, w, pos) as r
  from scored qualify r <= 3)
select video_id, string_agg(sentence, ' ' order by w, pos) as episode_summary, max(score) as best_score
from best join sentences using (video_id, w, pos) group by 1""", "chunks"))
def extract_summary(spark, sf):
    return en.extract_summary(chunks(spark, sf))


@query("hash_embed", sql("""
, slots as (select chunk_id, cast(('0x' || substring(md5(term), 1, 8)) as bigint) % 768 as slot, count(*) as n
  from (select chunk_id, unnest(list_filter(string_split_regex(lower(chunk_text), '[^\\p{L}\\p{N}]+'),
   lambda x: x <> '')) as term from chunks) x group by 1, 2)
select chunk_id, slot, round(n / sqrt(sum(n * n) over (partition by chunk_id)), 6) as weight from slots""", "chunks"))
def hash_embed(spark, sf):
    """Filled slots of the sparse form, which the dense vector is made from."""
    made = chunks(spark, sf).select("chunk_id", F.explode(en.hash_weights(F.col("chunk_text"))).alias("e"))
    return made.select("chunk_id", "e.slot", F.round("e.weight", 6).alias("weight"))


@query("hash_embed_dense", sql("""
, slots as (select chunk_id, cast(('0x' || substring(md5(term), 1, 8)) as bigint) % 768 as slot, count(*) as n
  from (select chunk_id, unnest(list_filter(string_split_regex(lower(chunk_text), '[^\\p{L}\\p{N}]+'),
   lambda x: x <> '')) as term from chunks) x group by 1, 2)
select c.chunk_id, 768 as dims, count(s.slot) as filled,
 case when count(s.slot) = 0 then 0.0::double else 1.0::double end as length,
 coalesce(min(s.slot), -1) as first_slot from chunks c left join slots s using (chunk_id) group by 1""", "chunks"))
def hash_embed_dense(spark, sf):
    e = F.col("embedding")
    first = F.array_position(F.transform(e, lambda x: x != 0), True) - 1
    return en.hash_embed(chunks(spark, sf)).select(
        "chunk_id", F.size(e).alias("dims"),
        F.size(F.filter(e, lambda x: x != 0)).cast("long").alias("filled"),
        F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))), 4)
        .alias("length"), first.alias("first_slot"))


def embeddings(spark, sf):
    return t.table(spark, sf, "embeddings")


_COSINE = "list_cosine_similarity(cast({0} as double[]), cast({1} as double[]))"


@query("vector_topk", f"""
select vec_id, label, round({_COSINE.format('embedding', '(select embedding from embeddings where vec_id = 0)')}, 6)
 as score from embeddings order by score desc, vec_id limit 8""")
def vector_topk(spark, sf):
    vectors = embeddings(spark, sf)
    return s.vector_topk(vectors, s.vector_of(vectors, "vec_id", 0), key="vec_id")


_NEIGHBORS = f"""
select query_id, vec_id, round(round(score, 9), 6) as score, rank from (
 select a.vec_id as query_id, b.vec_id, {_COSINE.format('a.embedding', 'b.embedding')} as score,
  row_number() over (partition by a.vec_id order by
   round({_COSINE.format('a.embedding', 'b.embedding')}, 9) desc, b.vec_id) as rank
 from embeddings a join embeddings b on {{0}}) x where rank <= {{1}}"""


def _rounded(found):
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("vector_neighbors", _NEIGHBORS.format("a.vec_id <> b.vec_id", 5))
def vector_neighbors(spark, sf):
    return _rounded(s.vector_neighbors(embeddings(spark, sf), key="vec_id"))


@query("batch_search", _NEIGHBORS.format("a.label = 3", 8))
def batch_search(spark, sf):
    vectors = embeddings(spark, sf)
    asked = vectors.filter("label = 3").withColumnRenamed("vec_id", "query_id")
    return _rounded(s.batch_search(asked, vectors, key="vec_id"))


@query("batch_search_blocks", _NEIGHBORS.format("true", 3))
def batch_search_blocks(spark, sf):
    """The way taken when the query table is too large to send to every task."""
    vectors = embeddings(spark, sf)
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    return _rounded(s.batch_search(asked, vectors, 3, key="vec_id", broadcast_bytes=0))


def _dated_vectors(spark, sf):
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("claim_id"), F.col("label").alias("topic"),
        F.date_add(F.lit("2022-01-01").cast("date"), ((F.col("vec_id") * 37) % 1400).cast("int")).alias("claim_date"),
        "embedding")


@query("similarity_pairs", f"""
select a.label as topic, a.vec_id as original_claim_id, b.vec_id as evolved_claim_id,
 (b.vec_id * 37) % 1400 - (a.vec_id * 37) % 1400 as time_delta_days,
 round({_COSINE.format('a.embedding', 'b.embedding')}, 6) as similarity_score
from embeddings a join embeddings b on a.label = b.label
 and (b.vec_id * 37) % 1400 - (a.vec_id * 37) % 1400 > 30
 and {_COSINE.format('a.embedding', 'b.embedding')} > 0.7""")
def similarity_pairs(spark, sf):
    rows = _dated_vectors(spark, sf)
    return s.similar_pairs(rows.drop("embedding"), rows.select("claim_id", "embedding"))


QUERY = "the transcript of the and with"
_BM25 = """, docs as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws
  from documents),
 st as (select count(*) as n, avg(len(ws)) as al from docs),
 hits as (select doc_id, len(ws) as dl, unnest(ws) as term from docs),
 tf as (select doc_id, dl, term, count(*) as tf from hits
  where term in ('the', 'transcript', 'of', 'and', 'with') group by 1, 2, 3),
 df as (select term, count(*) as df from tf group by 1),
 bm as (select doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
  / (tf + 1.2::double * (0.25::double + 0.75::double * dl / al))), 4) as score
  from tf join df using (term), st group by 1)"""


def documents(spark, sf):
    return t.documents(spark, sf).select("doc_id", "text")


@query("bm25_topk", "with " + _BM25[2:] + " select doc_id, score from bm order by score desc, doc_id limit 10")
def bm25_topk(spark, sf):
    return s.bm25_topk(documents(spark, sf), QUERY, key="doc_id", text="text")


@query("bm25_index", "with " + _BM25[2:] + " select doc_id, score from bm order by score desc, doc_id limit 10")
def bm25_index(spark, sf):
    """The same ranking from posting rows and corpus figures, as a stored index holds them."""
    docs = documents(spark, sf)
    return s.bm25_topk(
        docs, QUERY, key="doc_id", text="text", index=en.postings(docs, "doc_id", "text"),
        stats=s.corpus_stats(docs, "text"))


@query("hybrid_topk", "with " + _BM25[2:] + f""",
 kw as (select doc_id as id, row_number() over (order by score desc, doc_id) as keyword_rank from bm),
 vs as (select vec_id as id, round({_COSINE.format('embedding', '(select embedding from embeddings where vec_id = 0)')}, 6)
  as score from embeddings),
 vec as (select id, row_number() over (order by score desc, id) as vector_rank from vs)
select coalesce(vec.id, kw.id) as doc_id, coalesce(vector_rank, 0) as vector_rank,
 coalesce(keyword_rank, 0) as keyword_rank,
 round(coalesce(1.0::double / (60 + vector_rank), 0) + coalesce(1.0::double / (60 + keyword_rank), 0), 8) as score
from vec full join kw on vec.id = kw.id order by score desc, doc_id limit 10""")
def hybrid_topk(spark, sf):
    vectors = embeddings(spark, sf).withColumnRenamed("vec_id", "doc_id")
    near = s.vector_scores(vectors, s.vector_of(vectors, "doc_id", 0))
    relevant = s.bm25_topk(documents(spark, sf), QUERY, None, key="doc_id", text="text")
    fused = s.hybrid_topk(near, relevant, key="doc_id")
    return fused.withColumns({c: F.col(c).cast("long") for c in ("vector_rank", "keyword_rank")}).fillna(0)


_CHUNK_BM25 = """, docs as (select chunk_id, list_filter(string_split_regex(lower(chunk_text), '[^\\p{L}\\p{N}]+'),
   lambda x: x <> '') as ws from chunks),
 st as (select count(*) as n, avg(len(ws)) as al from docs),
 hits as (select chunk_id, len(ws) as dl, unnest(ws) as term from docs),
 tf as (select chunk_id, dl, term, count(*) as tf from hits where term in ('more', 'music') group by 1, 2, 3),
 df as (select term, count(*) as df from tf group by 1),
 bm as (select chunk_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
  / (tf + 1.2::double * (0.25::double + 0.75::double * dl / al))), 4) as score
  from tf join df using (term), st group by 1)"""


@query("search_results", sql(_CHUNK_BM25 + """
select left(c.chunk_text, 150) as chunk_text, episode_title, channel_name, youtube_url,
 strftime(publish_date, '%Y-%m-%d') as publish_date, chunk_id, score from
 (select * from bm order by score desc, chunk_id limit 8) b join chunks c using (chunk_id)""", "chunks"))
def search_results(spark, sf):
    rows = chunks(spark, sf)
    return s.result_view(s.bm25_topk(rows, "music more", 8), rows, 150).withColumn(
        "publish_date", day("publish_date"))


@query("refined_results", sql(_CHUNK_BM25 + """
select chunk_id, score, channel_name, strftime(publish_date, '%Y-%m-%d') as publish_date
from bm join chunks c using (chunk_id)
where channel_name in ('src1', 'src2', 'src3') and publish_date >= date '2023-01-01'
 and publish_date <= date '2025-01-01'""", "chunks"))
def refined_results(spark, sf):
    """All that match, narrowed by channel and date before the ranking."""
    rows = chunks(spark, sf)
    where = narrowed(["src1", "src2", "src3"], date_from="2023-01-01", date_to="2025-01-01")
    hits = s.result_view(s.bm25_topk(rows, "music more", None, where=where), rows)
    return refine(hits, sort="date").select("chunk_id", "score", "channel_name", day("publish_date"))


@query("refined_top", sql(_CHUNK_BM25 + """
select chunk_id, score from bm join chunks c using (chunk_id)
where channel_name = 'src4' and publish_date >= date '2024-01-01'
order by score desc, chunk_id limit 10""", "chunks"))
def refined_top(spark, sf):
    """The best of those that meet the conditions, not what is left of the best."""
    return s.bm25_topk(chunks(spark, sf), "music more", 10, where=narrowed(["src4"], date_from="2024-01-01"))


@query("refined_by_topic", sql(_CHUNK_BM25 + """,
 words as (select chunk_id, unnest(""" + _TOKENS.format("chunk_text", 4) + """) as term from chunks)
select chunk_id, score from bm where chunk_id in (select chunk_id from words where contains(term, 'ent'))
order by score desc, chunk_id limit 10""", "chunks"))
def refined_by_topic(spark, sf):
    """Hits in chunks that have a topic with the given text in it; every long word counts as one."""
    rows = chunks(spark, sf)
    topics = en.postings(rows, least=4).select("chunk_id", F.col("term").alias("topic"))
    return s.bm25_topk(with_topic(rows, topics, "ENT"), "music more", 10, where=F.col("on_topic"))


@query("related_episodes", f"""
with dims as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
 means as (select label, list(m order by i) as v from (select label, i, avg(cast(x as double)) as m from dims group by 1, 2) y
  group by 1)
select label, round({_COSINE.format('v', '(select v from means where label = 3)')}, 6) as score
from means where label <> 3 order by score desc, label limit 5""")
def related_episodes(spark, sf):
    return s.related_episodes(embeddings(spark, sf), 3, by="label")


@query("related_by_topic", sql("""
, links as (select distinct video_id, 't:' || topic as link from claims
  union select distinct video_id, 'p:' || speaker from claims)
select video_id, count(*) as shared from links
where video_id <> '7' and link in (select link from links where video_id = '7')
group by 1 order by shared desc, video_id limit 5""", "claims"))
def related_by_topic(spark, sf):
    return s.related_by_topic(t.claims(spark, sf), "7")
