import pytest
from pyspark.sql import functions as F

from talkmine.operators import search as s
from talkmine.operators.chunking import chunk_payload
from talkmine.sources import sinks
from talkmine.sources import tables as t
from talkmine.streaming import refresh as r

SF = "/root/testdata/sf0.001"


def test_replayed_and_cut_short_batches_change_nothing(spark, tmp_path):
    payload = t.payload(spark, SF)
    tables = str(tmp_path / "tables")
    half = payload.filter(F.col("video_id").cast("int") < 100)
    r.refresh(half, tables)
    # Episodes of the second batch are stored, but the run dies before their chunks are.
    from talkmine.sources.sinks import load_episodes
    load_episodes(payload, f"{tables}/episodes")
    for _ in range(2):
        r.refresh(payload, tables)
    want = {x.chunk_id for x in chunk_payload(payload).collect()}
    got = [x.chunk_id for x in spark.read.parquet(f"{tables}/chunks").collect()]
    assert set(got) == want and len(got) == len(want)
    assert spark.read.parquet(f"{tables}/episodes").count() == payload.count()
    assert spark.read.parquet(f"{tables}/channels").count() == t.channels(spark, SF).count()
    index, stats = r.read_index(spark, tables, ["more"])
    direct = s.bm25_topk(chunk_payload(payload), "more", 5).collect()
    assert s.bm25_topk(index, "more", 5, index=index, stats=stats).collect() == direct


def test_index_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    r.maintain_postings(chunk_payload(t.payload(spark, SF)), str(tmp_path))
    index, _ = r.read_index(spark, str(tmp_path), ["more"])
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "term_bucket" in plan


def test_a_replayed_batch_writes_no_file(spark, tmp_path):
    payload = t.payload(spark, SF)

    def files():
        return sorted(p for name in ("episodes", "postings", "doc_lengths") for p in (tmp_path / name).rglob("*.parquet"))

    r.refresh(payload, str(tmp_path))
    before = files()
    r.refresh(payload, str(tmp_path))
    assert before and files() == before


@pytest.mark.parametrize("small", [0, 100])
def test_rows_meet_the_fewer_keys(spark, monkeypatch, small):
    monkeypatch.setattr(sinks, "SMALL_KEYS", small)
    keys = [None, None, 1, 1, 2, 3, 4]
    src = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, v int")
    for held in ([], [9], [None, 1], [1, 1], [1, 2, 3], [1, 2, 3, 4], [4, 3, 2]):
        table = spark.createDataFrame([(k,) for k in held], "k int")
        got = sinks.without_held(src, table, "k")
        assert got.columns == ["k", "v"]
        assert sorted(x.v for x in got.collect()) == [i for i, k in enumerate(keys) if k is None or k not in held]
    assert sinks.without_held(src.filter("k is not null"), src, "k") is None
