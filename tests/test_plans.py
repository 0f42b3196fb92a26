"""Physical plans that must not change for the worse."""

import re

import pytest
from pyspark.sql import functions as F

from talkmine.operators import chunking, enrichment, evolution, search, selection
from talkmine.sources import tables as t

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """A stored landing table, so that plans start at a scan."""
    path = str(tmp_path_factory.mktemp("landed"))
    t.payload(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_chunking_is_map_only(landed):
    for make in (chunking.chunk_payload, chunking.chunk_sliding, chunking.chunk_sentences):
        assert "Exchange" not in plan(make(landed))


def test_chunking_reads_only_what_it_needs(landed):
    schema = re.search(r"ReadSchema: (.*)", chunking.chunk_payload(landed)._jdf.queryExecution().explainString(
        landed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))).group(1)
    assert "segments" in schema and "view_count" not in schema and "words_per_minute" not in schema


def test_top_n_is_cut_before_the_shuffle(landed):
    rows = landed.withColumn("publish_date", F.to_date(F.left("publish_date", F.lit(10))))
    top = selection.top_n_per_key(rows, ["channel_name"], [F.desc("view_count"), "video_id"], 3)
    assert plan(top).count("WindowGroupLimit") == 2
    targets = selection.target_table(landed.sparkSession, [("src1", {2022: 2}, 30.0)])
    text = plan(selection.stratified_top_n(rows, targets))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "WindowGroupLimit" in text


def test_keyword_scan_shuffles_no_text(landed):
    chunks = chunking.chunk_payload(landed)
    text = plan(search.bm25_topk(chunks, "music more", 8))
    assert "hashpartitioning" not in text and "TakeOrderedAndProject" in text


def test_pairs_need_one_shuffle(spark):
    text = plan(evolution.topic_pairs(t.claims(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("make", [
    lambda chunks: enrichment.tfidf_topics(chunks), lambda chunks: enrichment.extract_summary(chunks)])
def test_no_cartesian_products(landed, make):
    text = plan(make(chunking.chunk_payload(landed)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
