import json

from pyspark.sql import functions as F

from talkmine.operators import metrics, selection
from talkmine.operators.selection import genre_of
from talkmine.sources import files, sinks

VTT = """WEBVTT
Kind: captions

00:00:01.000 --> 00:00:02.500 align:start position:0%
hello <c>there</c>

00:00:02.500 --> 00:00:03.000
hello there

00:00:03.000 --> 00:00:04.000
<i></i>

00:00:04.000 --> 00:00:05.000
hello there

01:05.250 --> 01:06.000
two
lines

01:00:00.000 --> 01:00:01.000
bye"""


def test_subtitles(spark):
    df = spark.createDataFrame([("f", VTT)], "file_id string, content string")
    got = [(r.text, r.start, r.duration) for r in files.vtt_rows(df).collect()]
    # The blank block between equal texts does not make them new.
    assert got == [("hello there", 1.0, 1.5), ("two lines", 65.25, 0.75), ("bye", 3600.0, 1.0)]


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_files_to_landing_rows(spark, tmp_path):
    def meta(i):
        return json.dumps({"video_id": i, "title": "T", "channel_id": "UC1", "channel_name": "No Priors",
                           "publish_date": "2024-01-01T00:00:00Z", "duration_minutes": 1.0, "view_count": 5, "like_count": 1})

    segs = json.dumps([{"text": "a b", "start": 0.0, "duration": 2.0}, {"text": "[Music]", "start": 30.0, "duration": 30.0}])
    folder = tmp_path / "no_priors"
    for i in ("ok", "listed", "lost", "odd"):
        write(folder, f"{i}_metadata.json", f"[{meta(i)}]" if i == "listed" else meta(i))
    write(folder, "bad_metadata.json", "{broken")
    write(folder, "bad_transcript.json", segs)
    write(folder, "ok_transcript.json", segs)
    write(folder, "listed_transcript.json", segs.encode().replace(b"a b", b"a \xff"))
    write(folder, "odd_transcript.json", '{"text": "no list"}')
    md, tr = files.read_metadata(spark, str(tmp_path)), files.read_transcripts(spark, str(tmp_path))
    good, bad, stats = files.quarantine(md, tr)
    assert sorted(r.file_id for r in good.collect()) == ["listed", "ok"]
    assert {r.file_id: r.outcome for r in bad.collect()} == {
        "lost": "skipped: no transcript", "odd": "skipped: bad transcript", "bad": "failed: metadata"}
    assert tuple(stats.first()) == (5, 2, 2, 1, 1)

    ready = md.filter("not bad").withColumn("genre", genre_of(F.col("folder"))).drop("bad")
    payload = metrics.merge_payload(ready, tr.drop("bad"), F.concat("folder", F.lit("/"), "video_id"))
    row = payload.filter("video_id = 'ok'").first()
    assert (row.genre, row.segment_count, row.total_words, row.coverage_pct, row.artifact_count, row.has_timestamp_gaps,
            row.load_source) == ("Technology & AI", 2, 3, 1.0, 1, True, "no_priors/ok")

    table = str(tmp_path / "episodes")
    for _ in range(2):
        sinks.load_episodes(payload, table)
    assert spark.read.parquet(table).count() == 2


def test_channels_and_ledger(spark, tmp_path):
    write(tmp_path, "channels.json", json.dumps({
        "metadata": {"date_range": "2022-01-01 to 2026-01-01", "min_duration_minutes": 30, "max_duration_minutes": 240},
        "channels": [{"channel_id": "1", "name": "A", "target_episodes": 2}, {"channel_id": "2", "name": "B", "target_episodes": 3}]}))
    write(tmp_path, "ledger.json", json.dumps({"channels": {"A": {"downloaded_ids": ["x", "y"]}, "B": {"downloaded_ids": ["z"]}}}))
    channels = files.read_channels(spark, str(tmp_path / "channels.json"))
    assert channels.first().date_after == "2022-01-01"
    todo = files.pending(channels, files.read_ledger(spark, str(tmp_path / "ledger.json"))).collect()
    assert [(r.name, r.remaining) for r in todo] == [("B", 2)]


def test_genres(spark):
    df = spark.createDataFrame([("Huberman Lab",), ("startalk-extra",), ("acquired",), ("zz",)], "f string")
    assert [r[0] for r in df.select(genre_of(F.col("f"))).collect()] == [
        "Science & Health", "Science & Health", "Technology & AI", "Unknown"]


def test_targets_and_exclusions(spark):
    rows = [(str(i), "A", 100.0, f"202{2 + i % 2}-03-01", 1000 - i) for i in range(20)] + [("short", "A", 5.0, "2022-03-01", 9999)]
    df = spark.createDataFrame(rows, "video_id string, channel_name string, duration_min double, d string, view_count int")
    df = df.withColumn("publish_date", F.to_date("d"))
    targets = selection.target_table(spark, [("A", {2022: 2, 2023: 1}, 30.0)])
    held = spark.createDataFrame([("0",)], "video_id string")
    got = sorted((r.year, r["rank"], r.video_id) for r in selection.stratified_top_n(df, targets, held).collect())
    assert got == [(2022, 1, "2"), (2022, 2, "4"), (2023, 1, "1")]
    assert selection.target_table(spark).count() == 18


def test_log_is_append_only(spark, tmp_path):
    entry = spark.createDataFrame([("1", "q")], "search_id string, query_text string")
    for _ in range(2):
        sinks.append_log(entry, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    first, again = (sorted(map(tuple, sinks.first_per_key(df, "k").collect())) for _ in range(2))
    assert first == again and [k for k, _ in first] == ["a", "b", "c"]
    assert sinks.first_per_key(df.filter("v < 3"), "k").count() == 2
