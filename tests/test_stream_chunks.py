"""Chunks of a stream of segments equal those of the table."""

import datetime
import random

from pyspark.sql import functions as F

from talkmine.operators.chunking import chunk_payload
from talkmine.sources import tables as t
from talkmine.streaming.chunks import stream_chunks

SF = "/root/testdata/sf0.001"
SEGMENT = "video_id string, segment_index long, start_time double, duration_sec double, text string, arrived timestamp"


def test_late_and_unordered_segments_give_the_same_chunks(spark, tmp_path):
    payload = t.payload(spark, SF).filter("cast(video_id as int) < 12")
    rows = payload.select("video_id", F.posexplode("segments").alias("i", "s")).select(
        "video_id", F.col("i").cast("long"), "s.start", "s.duration", "s.text").collect()
    rng, began = random.Random(3), datetime.datetime(2024, 1, 1)
    # each segment arrives up to 400 seconds after it was said, some of them twice
    arriving = sorted([(began + datetime.timedelta(seconds=(r[2] or 0) + rng.random() * 400), tuple(r)) for r in rows])
    arriving += rng.sample(arriving, 20)
    last = max(a for a, _ in arriving)
    size = -(-len(arriving) // 4)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SEGMENT).parquet(source)

    def run() -> None:
        stream_chunks(stream(), delay="15 minutes").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    for batch in range(4):
        part = arriving[batch * size:(batch + 1) * size]
        spark.createDataFrame([(*r, a) for a, r in part], SEGMENT).coalesce(1).write.mode("append").parquet(source)
        run()
    for minutes in (60, 120):  # time goes on, so that the last windows close
        later = last + datetime.timedelta(minutes=minutes)
        spark.createDataFrame([("clock", 0, 0.0, 1.0, "-", later)], SEGMENT).coalesce(1).write.mode("append").parquet(source)
        run()
    names = ["video_id", "chunk_window", "chunk_text", "chunk_start_sec", "chunk_end_sec", "segment_count", "word_count"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*names).collect())
    assert got == sorted(tuple(r) for r in chunk_payload(payload).select(*names).collect()) and got
