"""Checks on tables: each gives rows of (check_name, value, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.text import digest


def stack(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def _passed(bad: Column) -> Column:
    return F.when(bad == 0, "pass").otherwise("fail")


def null_checks(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Missing or blank values per column, all columns in one scan."""
    def missing(c: str) -> Column:
        blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        return F.count_if(blank).alias(c)

    counts = df.agg(*[missing(c) for c in columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(f"null {c} in {name}").alias("check_name"), F.col(c).alias("value")) for c in columns
    ])).alias("r")).select("r.*").withColumn("status", _passed(F.col("value")))


def unique(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys that occur more than once. Their digests are compared, as keys may be whole texts."""
    repeated = df.groupBy(digest(key)).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("value"))
    return repeated.select(
        F.lit(f"unique {'+'.join(key)} in {name}").alias("check_name"), "value", _passed(F.col("value")).alias("status"))


def refs(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``child`` without their ``parent``. Child rows are counted per key first."""
    counted = child.groupBy(key).agg(F.count("*").alias("n"))
    lost = counted.join(parent.select(key).distinct(), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("value"))
    return lost.select(F.lit(name).alias("check_name"), "value", _passed(F.col("value")).alias("status"))


def coverage(src: DataFrame, dst: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """How many keys of ``src`` are in ``dst``, and the percent."""
    have = dst.select(key).distinct().withColumn("_have", F.lit(True))
    found = src.select(key).distinct().join(have, key, "left")
    return found.agg(F.count(key).alias("total"), F.count("_have").alias("covered")).withColumn(
        "coverage_pct", F.round(F.col("covered") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0)), digits))


def banded_coverage(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    share = F.col("covered") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0))
    return coverage(src, dst, key, 2).withColumn(
        "status", F.when(share >= 99, "full").when(share >= 90, "partial").otherwise("low"))


def link_format(df: DataFrame, url: str, name: str) -> DataFrame:
    """Links that are not a watch link with a second."""
    good = F.col(url).rlike(r"^https://www\.youtube\.com/watch\?v=[^&\s]+&t=[0-9]+s?$")
    bad = df.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("value"))
    return bad.select(F.lit(f"link format in {name}").alias("check_name"), "value", _passed(F.col("value")).alias("status"))


def times_ordered(chunks: DataFrame) -> DataFrame:
    """Chunks that end before they start, or start outside their window."""
    start, end = F.col("chunk_start_sec"), F.col("chunk_end_sec")
    wrong = (end < start) | (F.floor(start / 120) != F.col("chunk_window"))
    return chunks.agg(F.count_if(wrong).alias("value")).select(
        F.lit("chunk times ordered").alias("check_name"), "value", _passed(F.col("value")).alias("status"))


def segments_ordered(payload: DataFrame) -> DataFrame:
    """Segments that start before the one ahead of them, counted inside each episode row."""
    from talkmine.functions.segments import previous
    from talkmine.functions.text import let
    back = let(F.col("segments"), lambda a: F.size(F.filter(
        a, lambda s, i: F.coalesce(s["start"] < previous(a, i)["start"], F.lit(False)))))
    return payload.agg(F.sum(back).alias("value")).select(
        F.lit("segment times ordered").alias("check_name"), "value", _passed(F.col("value")).alias("status"))


def accepted_values(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Rows whose value is outside the domain of its column, all columns in one scan."""
    counts = df.agg(*[F.count_if(~F.col(c).isin(allowed)).alias(c) for c, allowed in domains.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(f"values of {c}").alias("check_name"), F.col(c).alias("value")) for c in domains
    ])).alias("r")).select("r.*").withColumn("status", _passed(F.col("value")))


DOMAINS = {
    "claim_type": fixed.CLAIM_TYPES, "sentiment": fixed.SENTIMENTS, "speaker_role": fixed.ROLES,
    "attribution_confidence": fixed.CONFIDENCES, "verification_status": fixed.STATUSES,
}


def claim_domains(claims: DataFrame) -> DataFrame:
    return accepted_values(claims, {c: v for c, v in DOMAINS.items() if c in claims.columns})


def row_bands(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Row count per table: ok above its bound, low if not empty, else empty."""
    def band(name: str, df: DataFrame, least: int) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(
            F.lit(name).alias("check_name"), "value",
            F.when(F.col("value") > least, "ok").when(F.col("value") > 0, "low").otherwise("empty").alias("status"))

    return stack(*[band(name, df, least) for name, (df, least) in tables.items()])


def density_band(chunks: DataFrame, low: float = 20, high: float = 80) -> DataFrame:
    """Mean chunks per episode and whether it lies in the usual range."""
    counts = chunks.agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("v"))
    mean = F.col("n") / F.nullif(F.col("v"), F.lit(0))
    return counts.select(
        F.lit("chunks per video").alias("check_name"), F.round(mean, 1).alias("value"),
        F.when(mean.between(low, high), "ok").otherwise("check").alias("status"))


def health(tables: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """Rows and distinct episodes per layer."""
    return stack(*[
        df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("unique_videos")).select(
            F.lit(name).alias("layer"), "row_count", "unique_videos")
        for name, df in tables.items()])


def new_counts(src: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows and episodes not handled yet."""
    todo = src.join(done.select(key).distinct(), key, "left_anti")
    return todo.agg(F.count("*").alias("new_rows"), F.count_distinct(key).alias("new_videos"))
