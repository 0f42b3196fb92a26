"""Choosing which episodes to take: candidates, top-N, stratified targets, genres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmine import fixed_values as fixed
from talkmine.functions.ranking import literal_table


def candidates(
    episodes: DataFrame, min_minutes: float = 30, max_minutes: float = 240,
    after: str = "2022-01-01", language: str | None = None,
) -> DataFrame:
    """Episodes within a length range, published on or after a date, in one language."""
    kept = episodes.filter(
        F.col("duration_min").between(min_minutes, max_minutes)
        & (F.col("publish_date") >= F.lit(after).cast("date")))
    return kept.filter(F.col("language") == language) if language else kept


def without(df: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    return df if done is None else df.join(done.select(key), key, "left_anti")


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int, exclude: DataFrame | None = None,
    id_col: str = "video_id",
) -> DataFrame:
    """First ``n`` rows of each group. Groups are cut to ``n`` rows before the shuffle."""
    ranks = Window.partitionBy(*keys).orderBy(*order)
    return without(df, exclude, id_col).withColumn("rank", F.row_number().over(ranks)).filter(
        F.col("rank") <= n)


def ranked(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows overall, numbered from 1."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def target_table(spark, targets=fixed.YEAR_TARGETS) -> DataFrame:
    """Targets per channel and year as rows."""
    rows = [(name, year, n, shortest) for name, years, shortest in targets for year, n in years.items()]
    return literal_table(spark, rows, "channel_name string, year int, target int, min_minutes double")


def stratified_top_n(
    episodes: DataFrame, targets: DataFrame, exclude: DataFrame | None = None,
    max_minutes: float = 240,
) -> DataFrame:
    """Most viewed new episodes per channel and year, up to each stratum's target.

    The rank is first cut to the largest target, which Spark does ahead of the shuffle.
    """
    largest = targets.agg(F.max("target")).first()[0] or 0
    fresh = without(episodes.withColumn("year", F.year("publish_date")), exclude, "video_id")
    strata = targets.select("channel_name", "year", "target", "min_minutes")
    eligible = fresh.join(strata, ["channel_name", "year"]).filter(
        F.col("duration_min").between(F.col("min_minutes"), F.lit(max_minutes)))
    ranks = Window.partitionBy("channel_name", "year").orderBy(F.desc("view_count"), "video_id")
    numbered = eligible.withColumn("rank", F.row_number().over(ranks))
    return numbered.filter(F.col("rank") <= largest).filter(F.col("rank") <= F.col("target"))


def stratum_summary(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Per channel and year: target, episodes added, episodes failed."""
    counts = results.groupBy("channel_name", "year").agg(
        F.count_if(F.col("status") == "success").alias("added"),
        F.count_if(F.col("status") != "success").alias("failed"))
    zero = F.lit(0).cast("long")
    return targets.join(counts, ["channel_name", "year"], "left").select(
        "channel_name", "year", "target",
        F.coalesce("added", zero).alias("added"), F.coalesce("failed", zero).alias("failed"))


def channel_summary(results: DataFrame) -> DataFrame:
    """Per channel: attempted, succeeded, failed, skipped because already held."""
    status = F.col("status")
    return results.groupBy("channel_name").agg(
        F.count_if(status != "held").alias("attempted"),
        F.count_if(status == "success").alias("succeeded"),
        F.count_if((status != "success") & (status != "held")).alias("failed"),
        F.count_if(status == "held").alias("skipped"))


def genre_of(folder: Column, genres: dict[str, str] = fixed.GENRES) -> Column:
    """Genre by folder name: exact, else the first key that contains it or is in it."""
    key = F.translate(F.lower(folder), " -", "__")
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in genres.items()])
    exact = F.get(F.filter(table, lambda e: e["k"] == key), F.lit(0))["v"]
    near = F.get(F.filter(table, lambda e: key.contains(e["k"]) | e["k"].contains(key)), F.lit(0))["v"]
    return F.coalesce(exact, near, F.lit("Unknown"))


def min_words(episodes: DataFrame, least: int = 100) -> DataFrame:
    """Drop transcripts with fewer words."""
    from talkmine.functions.segments import total_words
    return episodes.filter(total_words(F.col("segments")) >= least)
