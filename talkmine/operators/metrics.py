"""Transcript metrics, quality score and corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions import segments as seg
from talkmine.functions.text import digest, ratio
from talkmine.session import cut_lineage


def _per(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is missing or not positive."""
    return F.coalesce(F.when(den > 0, num / den), F.lit(0.0))


def with_load_metrics(episodes: DataFrame, gap_sec: float = 5.0) -> DataFrame:
    """Metrics stored with the payload, from the ``segments`` array of each row."""
    segs, minutes = F.col("segments"), F.coalesce("duration_min", F.lit(0.0))
    counted = episodes.withColumns({
        "segment_count": seg.segment_count(segs),
        "total_words": seg.total_words(segs),
        "duration_covered": F.round(seg.covered_seconds(segs), 3),
        "artifact_count": seg.artifact_count(segs, fixed.LOAD_MARKERS),
        "has_timestamp_gaps": seg.has_gap(segs, gap_sec),
        "avg_segment_len_sec": F.round(seg.mean_length(segs), 7),
    })
    return counted.withColumns({
        "coverage_pct": F.round(_per(F.col("duration_covered"), minutes * 60), 6),
        "words_per_minute": F.round(_per(F.col("total_words"), minutes), 4),
        "has_transcript": F.lit(True),
    })


def merge_payload(metadata: DataFrame, transcripts: DataFrame, load_source: Column) -> DataFrame:
    """Pair metadata with its transcript and compute the load metrics.

    ``metadata`` carries a ``genre`` column; an episode without transcript is left out.
    """
    paired = metadata.withColumnRenamed("duration_minutes", "duration_min").join(
        transcripts.filter(F.col("segments").isNotNull()), "video_id")
    return stamp(with_load_metrics(paired), load_source)


def stamp(payload: DataFrame, load_source: Column) -> DataFrame:
    return payload.withColumns({
        "load_source": load_source, "source_file": load_source,
        "load_timestamp": F.current_timestamp().cast("timestamp_ntz"),
    })


def profile_metrics(
    episodes: DataFrame, gap_sec: float = 30.0, markers: list[str] = fixed.LOAD_MARKERS,
    ignore_case: bool = True, wpm_by: str = "video",
) -> DataFrame:
    """Unrounded metrics for profiling.

    ``wpm_by="video"`` divides words by the length of the video, ``"transcript"`` by the
    time the transcript covers. Episodes without transcript keep zero metrics.
    """
    segs, minutes = F.col("segments"), F.coalesce("duration_min", F.lit(0.0))
    counted = episodes.withColumns({
        "has_transcript": seg.segment_count(segs) > 0,
        "segment_count": seg.segment_count(segs),
        "total_words": seg.total_words(segs),
        "duration_covered": seg.covered_seconds(segs),
        "artifact_count": seg.artifact_count(segs, markers, ignore_case),
        "empty_segments": seg.empty_count(segs),
        "has_timestamp_gaps": seg.has_gap(segs, gap_sec),
        "avg_segment_duration": seg.mean_length(segs),
    })
    spoken = minutes if wpm_by == "video" else F.col("duration_covered") / 60
    return counted.withColumns({
        "coverage_pct": _per(F.col("duration_covered"), minutes * 60),
        "words_per_minute": _per(F.col("total_words"), spoken),
    })


def metrics_with_missing(metadata: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Every episode, with zero metrics where the transcript is missing."""
    paired = metadata.withColumnRenamed("duration_minutes", "duration_min").join(
        transcripts, "video_id", "left")
    found = profile_metrics(
        paired, markers=fixed.FLAG_MARKERS, ignore_case=False, wpm_by="transcript")
    return found.withColumn(
        "avg_segment_len_sec", _per(F.col("duration_covered"), F.col("segment_count")))


def quality_score(
    coverage: Column, artifact_ratio: Column, wpm: Column, gaps: Column, empty_ratio: Column
) -> Column:
    """40 % coverage, 20 % artifacts, 20 % speaking rate, 10 % gaps, 10 % empty segments."""
    zero = F.lit(0.0)
    by_coverage = (
        F.when(coverage.between(0.85, 1.05), 0.40)
        .when(coverage > 1.05, 0.35)
        .otherwise(0.40 * F.greatest(coverage / 0.85, zero)))
    by_rate = (
        F.when(wpm.between(100, 200), 0.20).when(wpm > 200, 0.15)
        .when(wpm >= 50, 0.10).otherwise(0.05))
    score = (
        by_coverage
        + 0.20 * F.greatest(1.0 - artifact_ratio * 10, zero)
        + by_rate
        + F.when(gaps, 0.0).otherwise(0.10)
        + 0.10 * F.greatest(1.0 - empty_ratio * 20, zero))
    return F.round(F.least(score, F.lit(1.0)), 3)


def with_quality(metrics: DataFrame) -> DataFrame:
    """Score and acceptance of each episode that has segments."""
    count = F.col("segment_count")
    high, medium = fixed.SCORE_TIERS
    score = F.col("quality_score")
    return metrics.filter(count > 0).withColumn("quality_score", quality_score(
        F.col("coverage_pct"), F.col("artifact_count") / count, F.col("words_per_minute"),
        F.col("has_timestamp_gaps"), F.col("empty_segments") / count,
    )).withColumns({
        "quality_band": F.when(score > high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW"),
        "accepted": score >= medium,
    })


def corpus_profile(scored: DataFrame) -> DataFrame:
    """One row: totals, averages, rates and bands of all scored episodes."""
    episodes = F.count("*")

    def banded(name: str) -> Column:
        return F.count_if(F.col("quality_band") == name)

    def per_episode(total: Column, digits: int) -> Column:
        return F.round(ratio(total, episodes), digits)

    def rate(part: str) -> Column:
        return F.round(ratio(F.sum(part) * F.lit(100.0), F.sum("segment_count")), 4)

    return scored.agg(
        episodes.alias("episodes"),
        banded("HIGH").alias("high"), banded("MEDIUM").alias("medium"), banded("LOW").alias("low"),
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.sum("segment_count").alias("total_segments"),
        per_episode(F.sum("segment_count"), 4).alias("avg_segments"),
        F.sum("total_words").alias("total_words"),
        per_episode(F.sum("total_words"), 4).alias("avg_words"),
        rate("artifact_count").alias("artifact_rate"),
        rate("empty_segments").alias("empty_rate"),
        F.count_if("has_timestamp_gaps").alias("gap_episodes"),
        F.round(ratio(F.count_if("has_timestamp_gaps") * F.lit(100.0), episodes), 4).alias("gap_rate"),
        F.round(F.avg("words_per_minute"), 4).alias("avg_wpm"),
        F.round(F.min("words_per_minute"), 4).alias("min_wpm"),
        F.round(F.max("words_per_minute"), 4).alias("max_wpm"),
        F.round(F.sum("duration_min") / 60, 4).alias("total_hours"),
        F.round(F.avg("duration_min"), 4).alias("avg_duration"),
        F.round(F.avg("coverage_pct") * 100, 4).alias("avg_coverage"),
        F.count_distinct("channel_name").alias("channels"),
        F.count_distinct("genre").alias("genres"),
    )


def breakdown(scored: DataFrame, by: str) -> DataFrame:
    """Episodes and mean score per genre or channel."""
    return scored.groupBy(by).agg(
        F.count("*").alias("episodes"),
        F.count_if("accepted").alias("accepted"),
        F.round(F.avg("quality_score"), 4).alias("avg_quality"),
        F.sum("total_words").alias("total_words"))


def configured_coverage(scored: DataFrame, config: DataFrame) -> DataFrame:
    """Each configured channel with its episode count, zero when none arrived."""
    found = scored.groupBy("channel_name").agg(F.count("*").alias("episodes"))
    return config.join(found, "channel_name", "left").select(
        *config.columns, F.coalesce("episodes", F.lit(0).cast("long")).alias("episodes"),
        F.col("episodes").isNotNull().alias("has_data"))


def leaderboard(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("quality_score"), "channel_name", "video_id")


def bottom_k(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy("quality_score", "video_id").limit(k)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of statistics per numeric column.

    The columns are stacked into (column, value) rows, so all of them are profiled in one
    scan and each distinct count is spread by value rather than gathered per column.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("s")).select("s.*")
    value = F.col("value")
    return stacked.groupBy("column_name").agg(
        F.count("*").alias("n"),
        F.count_if(value.isNull()).alias("n_null"),
        F.count_if(value == 0).alias("n_zero"),
        F.count_distinct("value").alias("n_distinct"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"), F.stddev("value").alias("std_value"),
        F.skewness("value").alias("skewness"))


def column_quantiles(df: DataFrame, columns: list[str], at=(0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of each column: the least value that the given share of values doesn't exceed.

    Equal values are counted first. Their running count adds up ranges of values, found by sorting,
    so no task needs all values of a column.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("s")).select("s.*").filter("value is not null")
    bins = stacked.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = cut_lineage(bins.repartitionByRange(parts, "column_name", "value").withColumn(
        "part", F.spark_partition_id()))
    sums = bins.groupBy("column_name", "part").agg(F.sum("n").alias("s"))
    column = Window.partitionBy("column_name")
    sums = sums.withColumns({"before": F.sum("s").over(column.orderBy("part")) - F.col("s"),
                             "total": F.sum("s").over(column)}).drop("s")
    inside = Window.partitionBy("column_name", "part").orderBy("value")
    seen = bins.join(F.broadcast(sums), ["column_name", "part"]).withColumn(
        "seen", F.col("before") + F.sum("n").over(inside))
    return seen.groupBy("column_name").agg(*[
        F.min(F.when(F.col("seen") >= F.col("total") * p, F.col("value"))).alias(f"q{int(p * 100):02d}") for p in at])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """How many rows repeat an earlier row with the same key, by digest of the key."""
    groups = df.groupBy(digest(key)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"))
