"""Episode files: metadata, transcripts, channel list, ledger and subtitle files.

Files are read whole as text, one row per file, and parsed by column expressions, so a
broken file becomes a row to report instead of a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmine.functions.segments import drop_repeats
from talkmine.functions.text import let, strict_json, strip_ws
from talkmine.schemas import CHANNEL_LIST, LEDGER, METADATA, SEGMENTS


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, content) of each file below ``path`` whose name matches a glob ``pattern``."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def name_part(path: Column, suffix: str) -> Column:
    """File name without folder and ``suffix``."""
    return F.regexp_extract(path, f"([^/]+){suffix}$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def parse_metadata(files: DataFrame) -> DataFrame:
    """One row per metadata file; an outer array is accepted. ``bad`` marks unreadable files."""
    body = F.col("content")
    listed = F.when(body.rlike(r"^\s*\["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = files.select(
        name_part(F.col("path"), r"_metadata\.json").alias("file_id"), folder_of(F.col("path")).alias("folder"),
        F.explode_outer(strict_json(listed, T.ArrayType(METADATA))).alias("m"))
    return rows.select("file_id", "folder", "m.*", F.col("m.video_id").isNull().alias("bad"))


def parse_transcripts(files: DataFrame) -> DataFrame:
    """(video_id, segments, bad) per transcript file; anything but a JSON array is bad."""
    parsed = F.when(F.col("content").rlike(r"^\s*\["), strict_json(F.col("content"), SEGMENTS))
    return files.select(
        name_part(F.col("path"), r"_transcript\.json").alias("video_id"), parsed.alias("segments"),
    ).withColumn("bad", F.col("segments").isNull())


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(read_files(spark, path, "*_metadata.json"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(read_files(spark, path, "*_transcript.json"))


def quarantine(metadata: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that can be loaded, files that cannot with the reason, and counts by outcome.

    An episode is skipped when its transcript is missing or not a list, and failed when its
    metadata cannot be read.
    """
    texts = transcripts.select(F.col("video_id").alias("file_id"), "segments", F.col("bad").alias("bad_text"))
    both = metadata.join(texts, "file_id", "left").withColumn(
        "outcome",
        F.when(F.col("bad"), "failed: metadata").when(F.col("bad_text").isNull(), "skipped: no transcript")
        .when(F.col("bad_text"), "skipped: bad transcript").otherwise("loaded"))
    loaded = F.col("outcome") == "loaded"
    good = both.filter(loaded).drop("bad", "bad_text", "outcome")
    stats = both.agg(
        F.count("*").alias("total"), F.count_if(loaded).alias("loaded"),
        F.count_if(F.col("outcome").startswith("skipped")).alias("skipped"),
        F.count_if(F.col("outcome").startswith("failed")).alias("failed"),
        F.count_distinct("folder").alias("channels"))
    return good, both.filter(~loaded).select("file_id", "folder", "outcome"), stats


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured channel, with the limits of the whole list."""
    lists = spark.read.schema(CHANNEL_LIST).option("multiLine", True).json(path)
    return lists.select(
        F.explode("channels").alias("c"), F.col("metadata.min_duration_minutes").alias("min_minutes"),
        F.col("metadata.max_duration_minutes").alias("max_minutes"),
        F.split("metadata.date_range", " to ")[0].alias("date_after"),
    ).select("c.*", "min_minutes", "max_minutes", "date_after")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(channel_name, video_id) of everything taken before."""
    ledger = spark.read.schema(LEDGER).option("multiLine", True).json(path)
    return ledger.select(F.explode("channels").alias("channel_name", "state")).select(
        "channel_name", F.explode("state.downloaded_ids").alias("video_id"))


def pending(channels: DataFrame, ledger: DataFrame) -> DataFrame:
    """Episodes still wanted per channel; complete channels are left out."""
    done = ledger.groupBy(F.col("channel_name").alias("name")).agg(F.count_distinct("video_id").alias("done"))
    left = F.col("target_episodes") - F.coalesce("done", F.lit(0))
    return channels.join(done, "name", "left").withColumn("remaining", left).filter(F.col("remaining") > 0)


# --- subtitles ---------------------------------------------------------------------------

def clock_seconds(c: Column) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS.mmm`` to seconds."""
    def part(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    return let(F.split(c, ":"), lambda p: (
        F.when(F.size(p) == 3, part(p, 0) * 3600 + part(p, 1) * 60 + part(p, 2))
        .when(F.size(p) == 2, part(p, 0) * 60 + part(p, 1)).otherwise(0.0)))


def _cue(block: Column) -> Column:
    """One subtitle block as a segment; the text is blank when the block is not a cue."""
    arrow = " --> "

    def build(lines: Column) -> Column:
        marks = F.filter(lines, lambda x: x.contains(arrow))
        first = F.array_position(F.transform(lines, lambda x: x.contains(arrow)), True)
        after = F.filter(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)),
                         lambda x: ~x.contains(arrow))
        words = F.array_join(F.filter(F.transform(after, strip_ws), lambda x: x != ""), " ")
        text = strip_ws(F.regexp_replace(words, "<[^>]+>", ""))
        times = F.split(F.get(marks, F.size(marks) - 1), arrow)
        start = clock_seconds(strip_ws(F.get(times, F.lit(0))))
        end = clock_seconds(F.get(F.split(strip_ws(F.get(times, F.lit(1))), " "), F.lit(0)))
        return F.struct(
            F.when(F.size(marks) > 0, text).otherwise("").alias("text"),
            F.round(start, 3).alias("start"), F.round(end - start, 3).alias("duration"))

    return let(F.split(strip_ws(block), "\n"), build)


def vtt_segments(content: Column) -> Column:
    """Segments of a subtitle file: blocks with a time line and text, repeats dropped."""
    lines = F.regexp_replace(content, "\r\n?", "\n")
    cues = F.transform(F.split(strip_ws(lines), "\n\n"), _cue)
    return drop_repeats(F.filter(cues, lambda s: s["text"] != ""))


def vtt_to_segments(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, segments) per subtitle file, inside the row."""
    return files.select(key, vtt_segments(F.col("content")).alias("segments"))


def vtt_rows(files: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per segment. Exploding the expression itself parses each file once."""
    return files.select(key, F.explode(vtt_segments(F.col("content"))).alias("s")).select(key, "s.*")
