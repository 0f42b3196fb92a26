import datetime as dt

from pyspark.sql import functions as F

from talkmine.operators import claims as c
from talkmine.operators import evolution as ev

CLAIM = ("claim_id string, topic string, speaker string, claim_date date, channel_name string, claim_text string")


def claim(i, topic, speaker, day, text=None):
    return (i, topic, speaker, dt.date.fromisoformat(day) if day else None, "ch", text or f"{i} " + "x" * 60)


def answers(spark, *raw):
    return spark.createDataFrame([(f"k{i}", r) for i, r in enumerate(raw)], "chunk_id string, raw string")


def test_answers_in_every_shape(spark):
    good = '{"claim_text": "a long enough claim", "claim_type": "prediction", "speaker_name": "Ann"}'
    df = c.parse_claims(answers(
        spark, f"[{good}]", f"```json\n[{good}]\n```", f"Here you go: [{good}] done", "[{broken", "[]", None, "no list"))
    assert sorted(r.chunk_id for r in df.collect()) == ["k0", "k1", "k2"]


def test_sanitized_values(spark):
    raw = ('[{"claim_text": "  claim number one  ", "claim_type": "guess", "speaker_name": " unknown ", "speaker_role": "HOST",'
           ' "attribution_confidence": "HIGH", "sentiment": "POSITIVE"}, {"claim_text": "short"},'
           ' {"claim_text": "claim number two", "speaker_name": "Ann", "speaker_role": "host",'
           ' "attribution_confidence": "odd", "topic": "AI"}]')
    df = c.parse_claims(answers(spark, raw))
    one, two = c.sanitize_claims(df).orderBy("claim_text").collect()
    assert (one.claim_text, one.claim_type, one.speaker, one.speaker_role, one.attribution_confidence, one.sentiment,
            one.topic) == ("claim number one", "OPINION", "Unknown", "UNKNOWN", "UNKNOWN", "positive", "General")
    assert (two.speaker, two.speaker_role, two.attribution_confidence, two.topic) == ("Ann", "HOST", "UNKNOWN", "AI")
    kept = c.sanitize_claims(df, reset_unknown=False).orderBy("claim_text").first()
    assert (kept.speaker, kept.speaker_role, kept.attribution_confidence) == ("Unknown", "HOST", "HIGH")
    again = {r.claim_id for r in c.sanitize_claims(df).collect()}
    assert again == {one.claim_id, two.claim_id} and len(one.claim_id) == 64


def test_null_keys_hide_nothing(spark):
    src = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    done = spark.createDataFrame([("a",), (None,)], "chunk_id string")
    assert [r.chunk_id for r in c.unprocessed(src, done, "chunk_id").collect()] == ["b"]


def test_pairs_of_ties_and_unfit_claims(spark):
    claims = spark.createDataFrame([
        claim("c2", "t", "Ann", "2024-01-01"), claim("c1", "t", "Bob", "2024-01-01"),
        claim("c4", "t", " ann ", "2024-03-01"), claim("c3", "t", "Ann", "2024-03-01"),
        claim("x1", "t", "Unknown", "2020-01-01"), claim("x2", "t", None, "2026-01-01"),
        claim("x3", "t", "Ann", "2026-01-01", "brief"), claim("x4", "t", "Ann", None),
        claim("s1", "short", "Ann", "2024-01-01"), claim("s2", "short", "Ann", "2024-01-20"),
        claim("n1", None, "Ann", "2024-01-01"), claim("n2", " ", "Ann", "2025-01-01"),
        claim("o1", "one", "Ann", "2024-01-01")], CLAIM)
    rows = ev.topic_pairs(claims).collect()
    assert [(r.topic, r.original_claim_id, r.evolved_claim_id, r.time_delta_days) for r in rows] == [("t", "c1", "c3", 60)]
    assert rows[0].same_speaker is False
    done = spark.createDataFrame([(rows[0].evolution_id,)], "evolution_id string")
    assert ev.topic_pairs(claims, done=done).isEmpty()


def test_budget_takes_the_largest_topics(spark):
    rows = [claim(f"{t}{i}", t, "Ann", f"2024-0{1 + i}-01") for t, n in (("a", 3), ("b", 5), ("c", 4)) for i in range(n)]
    got = ev.topic_pairs(spark.createDataFrame(rows, CLAIM), max_topics=2).collect()
    assert sorted(r.topic for r in got) == ["b", "c"]


def test_drift_answers(spark):
    got = ev.parse_drift(answers(
        spark, '{"drift_type": "revised", "analysis": " why "}', '```json\n{"drift_type": "odd"}\n```', "{broken",
        '{"drift_type": "ESCALATED"} and more')).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.drift_type, r.analysis) for r in got] == [("k0", "REVISED", "why"), ("k1", "CONFIRMED", "")]


def test_drift_rules(spark):
    rows = [("1", "rates will fall", "rates will not fall", False), ("2", "rates will fall", "rates might fall", False),
            ("3", "rates might fall", "rates will certainly fall", False),
            ("4", "gold is money", "houses beat stocks today", True), ("5", "gold is money", "gold is money", True)]
    df = spark.createDataFrame(rows, "id string, original_text string, evolved_text string, same_speaker boolean")
    got = {r.id: r.drift_type for r in ev.drift_rules(df).collect()}
    assert got == {"1": "CONTRADICTED", "2": "SOFTENED", "3": "ESCALATED", "4": "REVISED", "5": "CONFIRMED"}


def test_verdicts(spark):
    claims = spark.createDataFrame([("a", "PENDING"), ("b", "PENDING")], "claim_id string, verification_status string")
    verdicts = spark.createDataFrame(
        [("a", "FALSE", 1), ("a", "VERIFIED", 2), ("z", "FALSE", 1)],
        "claim_id string, verification_status string, last_verified int")
    got = {r.claim_id: r.verification_status for r in c.apply_verdicts(claims, verdicts).collect()}
    assert got == {"a": "VERIFIED", "b": "PENDING"}


def test_prompts_carry_context_and_are_cut(spark):
    df = spark.createDataFrame([("k", "x" * 5000, None)], "chunk_id string, chunk_text string, hosts string")
    row = c.build_prompts(df, "claims", context=["hosts"]).first()
    assert "hosts: Unknown" in row.prompt and row.prompt.endswith("text: " + "x" * 2000)


def test_jobs_are_spread_by_chunk(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("one").alias("channel_name"))
    sizes = c.spread_jobs(df, 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 400


def test_chunks_without_claims_are_not_asked_again(spark, tmp_path):
    from talkmine.sources.sinks import store_claims
    asked = answers(spark, '[{"claim_text": "a long enough claim"}]', "[]")
    for _ in range(2):
        store_claims(c.sanitize_claims(c.parse_claims(asked)), asked, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/claims").count() == 1
    assert c.unprocessed(asked, spark.read.parquet(f"{tmp_path}/processed_chunks"), "chunk_id").isEmpty()


def test_evolution_rows(spark):
    claims = spark.createDataFrame([claim("a", "t", "Ann", "2024-01-01"), claim("b", "t", "Ann", "2024-05-01")], CLAIM)
    pairs = ev.topic_pairs(claims)
    drifts = ev.parse_drift(pairs.select("evolution_id", F.lit('{"drift_type": "SOFTENED"}').alias("raw")))
    row = ev.evolution_rows(pairs, drifts).first()
    assert (row.drift_type, row.same_speaker, row.similarity_score, len(row)) == ("SOFTENED", True, None, 16)
