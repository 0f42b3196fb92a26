"""Append-only tables in which a re-run adds nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmine import fixed_values as fixed
from talkmine.session import cut_lineage

# Keys that may be sent to every task.
SMALL_KEYS = 100_000


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_rows(src: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the target does not hold. NULL keys in the target hide nothing."""
    return src if target is None else src.join(target.select(key).distinct(), key, "left_anti")


def upsert_new(target: DataFrame | None, src: DataFrame, key: str) -> DataFrame:
    """One new row per key that the target does not hold; known keys stay as they are."""
    rest = [c for c in src.columns if c != key]
    first = src.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return new_rows(first, target, key).select(*src.columns)


def _few(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Stored ``keys`` and their number, marked for broadcast when that is small."""
    stored = cut_lineage(keys.select(key))
    count = stored.count()
    return (F.broadcast(stored) if count <= SMALL_KEYS else stored), count


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key. Only keys are shuffled, and the rows of keys that do repeat."""
    repeated, count = _few(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), key)
    if count == 0:
        return df
    rest = [c for c in df.columns if c != key]
    chosen = df.join(repeated, key, "left_semi").groupBy(key).agg(
        F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r")).select(key, "r.*").select(*df.columns)
    return df.join(repeated, key, "left_anti").unionByName(chosen)


def without_held(src: DataFrame, held: DataFrame, key: str) -> DataFrame | None:
    """Rows of ``src`` whose key isn't in ``held``, None if all are. NULL keys are never held.

    Which keys are held is found from the keys alone. Mostly none is, or all are in a replayed batch,
    and then the rows, which carry whole transcripts, meet nothing. Else they meet the keys
    held or the new ones, whichever are fewer.
    """
    asked = src.select(key).distinct().join(
        held.select(key).distinct().withColumn("__held", F.lit(True)), key, "left")
    asked = cut_lineage(asked.select(F.col(key).alias("__key"), F.coalesce("__held", F.lit(False)).alias("__held")))
    new, old = asked.agg(F.count_if(~F.col("__held")), F.count_if("__held")).first()
    if not new or not old:
        return src if new else None
    fewer = asked.filter(F.col("__held") == F.lit(old <= new)).select("__key")
    fewer = F.broadcast(fewer) if min(new, old) <= SMALL_KEYS else fewer
    return src.join(fewer, src[key].eqNullSafe(F.col("__key")), "left_anti" if old <= new else "left_semi")


def append_new(src: DataFrame, path: str, key: str, partition_by: list[str] = ()) -> None:
    """Write the rows with new keys. Whole episodes are added, so ``key`` may repeat in ``src``."""
    target = read_table(src.sparkSession, path, src.schema)
    if target is not None:
        src = without_held(src, target, key)
        if src is None:
            return
    src.write.mode("append").partitionBy(*partition_by).parquet(path)


def channel_rows(episodes: DataFrame) -> DataFrame:
    return episodes.select(
        "channel_id", "channel_name", "genre",
        F.concat(F.lit(fixed.CHANNEL_URL), "channel_id").alias("youtube_url"))


def load_episodes(payload: DataFrame, path: str) -> None:
    """Add episodes that are not in the landing table yet, one row each."""
    append_new(first_per_key(payload, "video_id"), path, "video_id")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def write_report(profile: DataFrame, path: str, kind: str = "parquet") -> None:
    profile.write.mode("overwrite").format(kind).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Node and edge tables, one row per node key and per edge, partitioned by kind.

    ``overwrite`` reloads the graph; ``append`` adds what is not there yet.
    """
    spark = nodes.sparkSession
    for name, rows, keys, part in (
        ("nodes", nodes, ["label", "id"], "label"), ("edges", edges, ["type", "src", "dst"], "type"),
    ):
        rest = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")) if rest else \
            rows.distinct()
        rows, target = one.select(*keys, *(["_r.*"] if rest else [])).select(*rows.columns), f"{path}/{name}"
        held = read_table(spark, target) if mode == "append" else None
        if held is not None:
            rows = rows.join(held.select(*keys), keys, "left_anti")
        rows.write.mode(mode).partitionBy(part).parquet(target)


def store_claims(claims: DataFrame, answered: DataFrame, tables: str) -> None:
    """Add claims, then note every answered chunk, so one without claims is not asked again."""
    append_new(claims, f"{tables}/claims", "claim_id")
    append_new(answered.select("chunk_id").distinct(), f"{tables}/processed_chunks", "chunk_id")
