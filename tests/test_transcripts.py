import pytest
from pyspark.sql import functions as F

from talkmine.functions import segments as seg
from talkmine.operators import chunking, metrics, staging
from talkmine.schemas import SEGMENTS

SCHEMA = ("video_id string, channel_id string, channel_name string, genre string, title string, publish_date string,"
          " duration_min double, coverage_pct double, segments array<struct<text:string,start:double,duration:double>>")


def episode(video_id, segments, minutes=10.0, coverage=0.9, title="T"):
    return (video_id, "UC1", "ch", "g", title, "2024-05-06T00:00:00Z", minutes, coverage, segments)


def frame(spark, *episodes):
    return spark.createDataFrame(list(episodes), SCHEMA)


def arrays(spark, *lists):
    return spark.createDataFrame([(x,) for x in lists], "s " + SEGMENTS.simpleString())


def lines(n, every=4.0, text="some words in line"):
    return [(f"{text} {i}", i * every, 3.5) for i in range(n)]


@pytest.mark.parametrize("gap,five,thirty", [(4.0, False, False), (5.0, False, False), (6.0, True, False), (31.0, True, True)])
def test_gap_is_strictly_more_than_the_threshold(spark, gap, five, thirty):
    df = arrays(spark, [("a", 0.0, 2.0), ("b", 2.0 + gap, 2.0)])
    assert tuple(df.select(seg.has_gap(F.col("s"), 5), seg.has_gap(F.col("s"), 30)).first()) == (five, thirty)


def test_metrics_of_missing_and_empty_transcripts(spark):
    df = frame(spark, episode("a", None), episode("b", []), episode("c", [("x y", 0.0, 60.0)], 0.0))
    got = {r.video_id: r for r in metrics.with_load_metrics(df).collect()}
    for key in ("a", "b"):
        assert (got[key].segment_count, got[key].total_words, got[key].duration_covered) == (0, 0, 0.0)
        assert got[key].has_timestamp_gaps is False and got[key].avg_segment_len_sec == 0.0
    # A video of zero minutes has neither coverage nor a rate.
    assert (got["c"].coverage_pct, got["c"].words_per_minute) == (0.0, 0.0)


def test_artifacts_empties_and_repeats(spark):
    df = arrays(spark, [("[music]", 0.0, 1.0), ("  ", 1.0, 1.0), ("[Silence] x", 2.0, 1.0), ("y", 3.0, 1.0), ("y", 4.0, 1.0)])
    s = F.col("s")
    row = df.select(seg.artifact_count(s), seg.empty_count(s), seg.segment_count(seg.drop_repeats(s))).first()
    assert tuple(row) == (2, 1, 4)


def test_strip_overlap(spark):
    df = arrays(spark, [("a b", 0.0, 1.0), ("a b c", 1.0, 1.0), ("d", 2.0, 1.0)])
    assert [x.text for x in df.select(seg.strip_overlap(F.col("s")).alias("o")).first().o] == ["a b", "c", "d"]


@pytest.mark.parametrize("coverage,ratio,wpm,gaps,empty,want", [
    (0.85, 0, 150, False, 0, 1.0), (1.05, 0, 150, False, 0, 1.0), (1.06, 0, 150, False, 0, 0.95),
    (0.425, 0, 60, True, 0, 0.6), (0.0, 0.2, 10, True, 0.1, 0.05), (0.9, 0, 250, False, 0.025, 0.9)])
def test_quality_score(spark, coverage, ratio, wpm, gaps, empty, want):
    got = spark.range(1).select(metrics.quality_score(
        F.lit(float(coverage)), F.lit(float(ratio)), F.lit(float(wpm)), F.lit(gaps), F.lit(float(empty)))).first()[0]
    assert got == pytest.approx(want)


def test_acceptance_bounds(spark):
    df = spark.createDataFrame([(0.7,), (0.701,), (0.5,), (0.499,)], "quality_score double")
    base = df.withColumns({"segment_count": F.lit(1), "coverage_pct": F.lit(0.0), "artifact_count": F.lit(0),
                           "words_per_minute": F.lit(0.0), "has_timestamp_gaps": F.lit(False), "empty_segments": F.lit(0)})
    score = F.col("quality_score")
    band = F.when(score > 0.7, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")
    assert [r[0] for r in base.select(band).collect()] == ["MEDIUM", "HIGH", "MEDIUM", "LOW"]
    assert metrics.with_quality(base).select("quality_band", "accepted").distinct().count() == 1


def test_chunks_keep_every_segment_in_order(spark):
    shuffled = lines(100)[::-1]
    df = frame(spark, episode("v", shuffled, 8.0))
    rows = chunking.chunk_payload(df).orderBy("chunk_window").collect()
    assert [r.chunk_id for r in rows] == ["v_chunk_0000", "v_chunk_0001", "v_chunk_0002", "v_chunk_0003"]
    assert sum(r.segment_count for r in rows) == 100
    assert " ".join(r.chunk_text for r in rows) == " ".join(t for t, _, _ in lines(100))
    assert rows[1].youtube_url.endswith("v&t=120s")
    assert rows[0].transcript_quality == "HIGH" and str(rows[0].publish_date)[:10] == "2024-05-06"


def test_payload_and_segment_table_give_the_same_chunks(spark):
    df = frame(spark, episode("v", lines(300), 20.0), episode("w", lines(40, 9.0)), episode("x", [("tiny", 0.0, 1.0)]))
    from_rows = chunking.chunk_payload(df)
    table = staging.flatten_segments(df).join(df.select(
        "video_id", F.col("title").alias("episode_title"), F.lit("2024-05-06").cast("timestamp_ntz").alias("publish_date"),
        F.lit("HIGH").alias("transcript_quality")), "video_id")
    from_table = chunking.chunk_segments(table)
    columns = ["chunk_id", "chunk_text", "chunk_start_sec", "chunk_end_sec", "segment_count", "word_count"]
    assert sorted(map(tuple, from_rows.select(*columns).collect())) == sorted(
        map(tuple, from_table.select(*columns).collect()))
    assert from_rows.filter("video_id = 'x'").isEmpty()


def test_sliding_windows_share_the_overlap(spark):
    df = frame(spark, episode("v", lines(60), 4.0))
    rows = chunking.chunk_sliding(df, 60, 15).orderBy("chunk_window").collect()
    assert [r.chunk_start_sec for r in rows[:3]] == [0.0, 48.0, 92.0]
    assert all(len([x for x in rows if x.chunk_window * 45 <= t < x.chunk_window * 45 + 60]) >= 1 for t in range(0, 236, 4))
    with pytest.raises(ValueError):
        chunking.chunk_sliding(df, 60, 60)


def test_sentences_are_not_cut(spark):
    segs = [(f"part {i}" + ("." if i % 5 == 4 else ""), i * 10.0, 9.0) for i in range(30)]
    rows = chunking.chunk_sentences(frame(spark, episode("v", segs)), 120, 0, 5).orderBy("chunk_window").collect()
    assert all(r.chunk_text.endswith(".") for r in rows)
    assert sum(r.segment_count for r in rows) == 30


def test_neighbors_across_blocks(spark):
    df = frame(spark, episode("v", lines(400), 30.0))
    chunks = chunking.chunk_payload(df)
    for span in (2, 3, 1000):
        rows = chunking.with_neighbors(chunks, span).orderBy("chunk_window").collect()
        ids = [r.chunk_id for r in rows]
        assert [r.previous_segment_id for r in rows] == [None] + ids[:-1]
        assert [r.next_segment_id for r in rows] == ids[1:] + [None]


def test_views_drop_noise_and_handle_zero(spark):
    df = frame(spark, episode("v", [("ok text", 0.0, 1.0), ("hi", 1.0, 1.0), ("too short in time", 2.0, 0.05),
                                    ("[Music] la la", 3.0, 1.0)], 0.0))
    payload = metrics.stamp(metrics.with_load_metrics(df), F.lit("x")).withColumns({
        "duration_iso": F.lit("PT0S"), "video_url": F.lit("u"), "view_count": F.lit(0), "like_count": F.lit(3)})
    segs = staging.stg_segments(payload)
    assert [r.segment_id for r in segs.orderBy("segment_index").collect()] == ["v_00000", "v_00003"]
    channels = spark.createDataFrame([("UC9", "u")], "channel_id string, youtube_url string")
    episodes = staging.int_episodes(staging.stg_episodes(payload), channels)
    row = episodes.first()
    assert row.words_per_min is None and row.engagement_rate is None and row.channel_url is None
    assert row.estimated_chunks == 1 and row.publish_year == 2024
    assert staging.int_segments(segs, episodes).count() == 1
