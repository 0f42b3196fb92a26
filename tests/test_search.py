import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmine.functions.ranking import skew_join
from talkmine.operators import enrichment as en
from talkmine.operators import search as s
from talkmine.operators.staging import refine


def vectors(spark, n=120, dim=16, seed=3):
    matrix = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return matrix, spark.createDataFrame(rows, "chunk_id long, embedding array<float>")


def brute(matrix, k, skip):
    unit = matrix.astype("float64") / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    out = {}
    for i in range(len(matrix)):
        order = sorted((j for j in range(len(matrix)) if not (skip and i == j)), key=lambda j: (-scores[i, j], j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("limit", [s.BROADCAST_BYTES, 0])
def test_batch_search_is_exact_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(s, "QUERY_BLOCK", 50)
    monkeypatch.setattr(s, "VECTOR_BLOCK", 40)
    matrix, df = vectors(spark)
    rows = s.vector_neighbors(df, 4, broadcast_bytes=limit).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == brute(matrix, 4, True)


def test_single_search_and_zero_vector(spark):
    matrix, df = vectors(spark, 30)
    zero = spark.createDataFrame([(99, [0.0] * 16)], "chunk_id long, embedding array<float>")
    got = s.vector_topk(df.unionByName(zero), s.vector_of(df, "chunk_id", 0), 30).collect()
    assert [r.chunk_id for r in got] == brute(matrix, 30, False)[0]


def test_empty_query_table(spark):
    _, df = vectors(spark, 5)
    none = df.filter("chunk_id < 0").withColumnRenamed("chunk_id", "query_id")
    assert s.batch_search(none, df).isEmpty()


@pytest.mark.parametrize("block", [7, 2000])
def test_similar_pairs_against_all_pairs(spark, block):
    matrix, df = vectors(spark, 80, 4)
    claims = df.select(
        F.col("chunk_id").alias("claim_id"), F.when(F.col("chunk_id") % 4 == 0, "rare").otherwise("hot").alias("topic"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("chunk_id") * 7 % 90).cast("int")).alias("claim_date"))
    vecs = df.withColumnRenamed("chunk_id", "claim_id")
    got = {(r.original_claim_id, r.evolved_claim_id) for r in s.similar_pairs(claims, vecs, block=block).collect()}
    unit = matrix.astype("float64") / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = {(a, b) for a in range(80) for b in range(80)
            if (a % 4 == 0) == (b % 4 == 0) and b * 7 % 90 - a * 7 % 90 > 30 and unit[a] @ unit[b] > 0.7}
    assert got == want and want


def test_skew_join_equals_plain_join(spark):
    left = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1200)).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1), ("lonely", -2)], "k string, id long"))
    right = left.filter("k is not null and k <> 'lonely'").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    want = sorted(map(tuple, left.join(right, "k").select("k", "id", "n", "v").collect()))
    assert sorted(map(tuple, skew_join(left, right, "k", "n").select("k", "id", "n", "v").collect())) == want


def test_hot_rows_are_spread(spark):
    left = spark.range(20000).select(F.lit("hot").alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in skew_join(left, right, "k", "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def docs(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "v", i, x) for i, x in enumerate(texts)],
                                 "chunk_id string, video_id string, chunk_window int, chunk_text string")


def test_bm25_ranks_rare_terms_first(spark):
    df = docs(spark, "alpha beta", "beta beta beta", "gamma delta", "beta gamma")
    got = [r.chunk_id for r in s.bm25_topk(df, "Alpha, beta!", 10).collect()]
    assert got[0] == "c0" and set(got) == {"c0", "c1", "c3"}


def test_hybrid_keeps_hits_of_either_list(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "chunk_id string, score double")
    b = spark.createDataFrame([("y", 5.0), ("z", 4.0)], "chunk_id string, score double")
    assert [r.chunk_id for r in s.hybrid_topk(a, b).collect()] == ["y", "x", "z"]


def test_hybrid_agrees_with_ranking_in_full(spark):
    """Long lists with ties and nulls, in which some of the best stand far down in one list."""
    import random
    rng = random.Random(5)
    near = {f"d{i:04}": round(rng.random(), 2) if i % 7 else None for i in range(900)}
    said = {f"d{i:04}": round(rng.random(), 2) for i in range(300, 1200)}
    lists = [spark.createDataFrame(list(x.items()), "chunk_id string, score double") for x in (near, said)]
    rank = [{i: n for n, i in enumerate(sorted(x, key=lambda i: (-(-1 if x[i] is None else x[i]), i)), 1)} for x in (near, said)]
    worth = {i: round(sum(1 / (3 + r[i]) for r in rank if i in r), 8) for i in {**near, **said}}
    want = sorted(worth, key=lambda i: (-worth[i], i))[:12]
    got = s.hybrid_topk(*lists, k=12, smooth=3).collect()
    assert [(r.chunk_id, r.vector_rank, r.keyword_rank, r.score) for r in got] == [
        (i, rank[0].get(i), rank[1].get(i), worth[i]) for i in want]


def test_dense_vector_has_unit_length(spark):
    df = en.hash_embed(docs(spark, "one two two three", ""), 64)
    full, empty = [r.embedding for r in df.orderBy("chunk_id").collect()]
    assert len(full) == len(empty) == 64 and sum(empty) == 0
    assert sum(x * x for x in full) == pytest.approx(1, abs=1e-5)


def test_topics_entities_and_summary(spark):
    df = docs(spark, "quantum quantum physics with common words here. Ada Lovelace met Alan Turing.",
              "common words here again and again. Ada Lovelace wrote notes.")
    topics = {(r.chunk_id, r.rank): r.topic for r in en.tfidf_topics(df).collect()}
    assert topics[("c0", 1)] == "quantum"
    entities = {(r.chunk_id, r.entity): r.mentions for r in en.cap_entities(df).collect()}
    assert entities == {("c0", "Ada Lovelace"): 1, ("c0", "Alan Turing"): 1, ("c1", "Ada Lovelace"): 1}
    assert "Alan Turing" in en.extract_summary(df, 1).first().episode_summary


def test_refine(spark):
    rows = [("a", "x", "AI", "2024-01-01", 1.0), ("b", "y", "AI", "2024-06-01", 3.0), ("c", "x", "Bio", "2025-01-01", 2.0)]
    df = spark.createDataFrame(rows, "chunk_id string, channel_name string, topic string, publish_date string, score double")
    df = df.withColumn("publish_date", F.to_date("publish_date"))
    ids = lambda found: [r.chunk_id for r in found.collect()]
    assert ids(refine(df)) == ["b", "c", "a"]
    assert ids(refine(df, channels=["x"], sort="date")) == ["c", "a"]
    assert ids(refine(df, topic="ai", date_from="2024-02-01")) == ["b"]
    assert ids(refine(df, date_to="2024-12-31", sort="channel")) == ["a", "b"]


def test_literal_query_vector(spark):
    from talkmine.functions.vectors import unit
    matrix, df = vectors(spark, 20)
    by_row = s.vector_topk(df, s.vector_of(df, "chunk_id", 3), 20).collect()
    assert s.vector_topk(df, unit(F.lit([float(x) for x in matrix[3]])), 20).collect() == by_row
