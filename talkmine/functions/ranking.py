"""Ordered picks that pre-aggregate before the shuffle, and joins that survive hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine.session import cut_lineage


def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """First ``k`` rows; ``order`` ends in a unique key so ties are settled."""
    return df.orderBy(*order).limit(k)


def places(df: DataFrame, score: str, key: str, asked: list[tuple]) -> list[int]:
    """Places of some rows, given as (score, key), in ``df`` by falling score (null last), then key.

    One pass counts in every task how many rows come before each; nothing is sorted or moved but
    these counts. Meant for a bounded number of rows.
    """
    asked = [(-np.inf if s is None else s, k) for s, k in asked]
    wanted = np.array([s for s, _ in asked])

    def count(batches):
        before = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            scores = batch.column(0).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            before += len(scores) - np.searchsorted(np.sort(scores), wanted, "right")
            tied = np.isin(scores, wanted)
            if tied.any():
                keys, same = np.asarray(batch.column(1).to_pylist(), dtype=object)[tied], scores[tied]
                for value in np.unique(same):
                    own = np.sort(keys[same == value])
                    for i in np.flatnonzero(wanted == value):
                        before[i] += np.searchsorted(own, asked[i][1], "left")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), pa.array(before)], names=["i", "n"])

    counted = df.select(F.col(score).cast("double"), key).mapInArrow(count, "i int, n long")
    total = {r["i"]: r["n"] for r in counted.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [total.get(i, 0) + 1 for i in range(len(asked))]


def count_by_case(df: DataFrame, keys: list[str], column: str, names: dict[str, str]) -> DataFrame:
    """Total and one conditional count per value of ``column``: ``names`` maps value to alias."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(column) == value).alias(alias) for value, alias in names.items()])


def collect_distinct(df: DataFrame, keys: list[str], column: str, alias: str) -> DataFrame:
    """Distinct values per key, sorted. Rows are made distinct before they are gathered."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list(column)).alias(alias))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and percent of all rows; the total is summed over the small groups."""
    groups = df.groupBy(key).agg(F.count("*").alias("count"))
    total = groups.agg(F.sum("count").alias("total")).scalar()
    return groups.withColumn("pct", F.round(F.col("count") * F.lit(100.0) / total, 1))


def literal_table(spark: SparkSession, rows: list, schema: str, most: int = 10_000) -> DataFrame:
    """Rows written in a program as a table. Up to ``most`` rows it is sent to every task."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= most else made


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join on a key that may hold a large share of ``left``.

    ``right`` has one row per key, and ``weight`` says how many ``left`` rows carry it. It is
    stored once, being small beside ``left`` but often costly to derive. A key with more than
    a thousandth of all rows is hot; there are fewer than a thousand of those whatever the
    data, so they are broadcast. The others are joined by shuffle on (hash of key, key), in
    which rows already answered carry a hash of the whole row and so spread over all tasks.
    """
    right = cut_lineage(right)
    total = right.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in right.columns if c != key]
    is_hot = F.col(weight) * 1000 > total
    hot = right.filter(is_hot).select(key, F.struct(*values).alias("_hot"))
    cold = right.filter(~is_hot).select(
        key, F.xxhash64(key).alias("_place"), F.struct(*values).alias("_cold"))
    first = left.join(F.broadcast(hot), key, "left")
    place = F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*left.columns))
    both = first.withColumn("_place", place).join(cold, ["_place", key], "left")
    found = both.withColumn("_found", F.coalesce("_hot", "_cold")).filter(F.col("_found").isNotNull())
    return found.select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])
