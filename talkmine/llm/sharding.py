"""Shards of equal size in bytes, tokens and rows at once, by vector bin packing.

Equal texts form a group, and a group goes as a whole into the shard where the dot product of its
vector (its share of all bytes, tokens and rows) with the shard's residual capacity is highest.
Greedy placing is sequential, so what is placed must be few: a group is placed by itself only if it
is large, which by arithmetic few can be; the others are placed in bundles that a hash of the text
deals them into, several thousand at any size of corpus. Bundles halve in size from level to
level and are placed last, as the sand between the stones; each holds texts of one kind (short or
long, few or many tokens to the byte), so that there are bundles to even out every dimension.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmine.llm.text import WORD_PATTERN
from talkmine.session import cut_lineage

SHARDS = 40
#: bytes that a row takes besides its text
OVERHEAD = 16
LAW = "bytes"
SIZES = ("bytes", "tokens", "rows")
#: levels of bundles, and bundles of each kind and level to a shard
LEVELS, GRAIN = 8, 8
#: a group of more than this share of a shard's capacity is placed by itself
LARGE = 1 / 32
#: a group stays whole up to this share of a shard's capacity, then it is cut into pieces
WHOLE = 1 / 16
#: rows that one task numbers
CELL = 20_000


def facts(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, crc32, bytes and tokens of its text, and a number
    ``_copy`` that tells repeated rows apart. Repeated rows cross the network as one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("_digest"), F.crc32(text.cast("binary")).alias("_crc"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("_bytes"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("_tokens"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(None).cast("int").alias("_none")]).alias("_kept"))
    same = seen.groupBy(*seen.columns).agg(F.count("*").alias("_n"))
    return same.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def _sums() -> list[Column]:
    return [F.sum("_bytes").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")]


def _share(totals: dict, shards: int) -> Column:
    """A group's largest size as a share of a shard's capacity."""
    return F.greatest(*[F.col(s) * shards / float(totals[s]) for s in SIZES if totals[s]] + [F.lit(0.0)] * 2)


def _bundle(totals: dict, shards: int) -> Column:
    """Name of the bundle of a small group: level, kind, and one of those of that level and kind."""
    dealt = F.xxhash64("_digest")
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(dealt.bitwiseAND(1 << i) != 0, i).otherwise(level)
    long = F.col("_bytes") * totals["rows"] > totals["bytes"]
    wordy = F.col("_tokens").cast("double") * totals["bytes"] > F.col("_bytes").cast("double") * totals["tokens"]
    place = F.pmod(F.shiftrightunsigned(dealt, LEVELS), F.lit(shards * GRAIN))
    return F.concat_ws(":", F.lit("bundle"), level.cast("string"), long.cast("int").cast("string"),
                       wordy.cast("int").cast("string"), place.cast("string"))


def with_items(rows: DataFrame, totals: dict, shards: int) -> DataFrame:
    """What each row is placed with: its bundle, or its large group or a piece of that.

    A shard has at most ``3 / LARGE`` times its share of groups as large as that, so they are
    broadcast. The rows of a group that is cut are dealt by a hash of their ids and copies.
    """
    share = _share(totals, shards)
    large = rows.groupBy("_digest").agg(*_sums()).filter(share > LARGE).select(
        "_digest", F.when(share > WHOLE, F.least(F.ceil(share / WHOLE), F.col("rows"))).otherwise(1).alias("_pieces"))
    piece = F.pmod(F.xxhash64("doc_id", "_copy", "_kept"), F.col("_pieces"))
    return rows.join(F.broadcast(large), "_digest", "left").withColumn("_item", F.when(
        F.col("_pieces").isNull(), _bundle(totals, shards)).otherwise(
        F.concat_ws(":", F.hex("_digest"), piece.cast("string")))).drop("_pieces")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, largest first; ``vectors`` are shares of a shard's capacity.

    Ties go to the earlier item and the smaller shard. Where all shards are full, residual
    capacities are negative and the rule is the same.
    """
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        out[i] = np.argmax(residual @ vectors[i])
        residual[out[i]] -= vectors[i]
    return out


def _placed(items: list, totals: dict, shards: int) -> list[tuple[str, int]]:
    items = sorted(items, key=lambda r: r["_item"])
    shares = np.array([[r[s] * shards / totals[s] if totals[s] else 0.0 for s in SIZES] for r in items]).reshape(-1, len(SIZES))
    return list(zip((r["_item"] for r in items), place(shares, shards).tolist()))


def _packed(docs: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """Facts of each row with ``_shard`` and ``_slot``; the columns ``keep`` come along in ``_kept``."""
    rows = cut_lineage(facts(docs, keep))
    totals = rows.agg(*_sums()).first().asDict()
    if not totals["rows"]:
        totals = dict.fromkeys(SIZES, 0)
    rows = with_items(rows, totals, shards)
    # as many rows as there are bundles and large groups, whatever the size of the corpus
    items = rows.groupBy("_item").agg(*_sums()).collect()
    where = docs.sparkSession.createDataFrame(_placed(items, totals, shards), "_item string, _shard int")
    cells = max(1, -(-totals["rows"] // (shards * CELL)))
    dealt = rows.join(F.broadcast(where), "_item").withColumn(
        "_cell", F.pmod(F.xxhash64("doc_id", "_digest", "_copy", "_kept"), F.lit(cells)))
    filled = dealt.groupBy("_shard", "_cell").agg(F.count("*").alias("_filled"))
    before = filled.withColumn("_before", F.sum("_filled").over(
        Window.partitionBy("_shard").orderBy("_cell")) - F.col("_filled")).drop("_filled")
    inside = F.row_number().over(Window.partitionBy("_shard", "_cell").orderBy("doc_id", "_digest", "_copy", "_kept"))
    return dealt.withColumn("_inside", inside).join(before, ["_shard", "_cell"]).withColumn(
        "_slot", F.col("_before") + F.col("_inside") - 1)


def pack(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs`` (doc_id, text).

    A null text is an empty one, of ``OVERHEAD`` bytes. Texts, equal if all their characters are, stay
    together up to ``WHOLE`` of a shard; one document is never cut, so a single one larger than a
    shard's share makes its shard the largest. Rows without an id, rows that repeat an id and
    rows repeated in full are each placed. Slots number a shard's rows from 0 without a gap. An
    empty table gives no rows; other columns are ignored. The same rows get the same shards, in
    whatever order they come; ``grown_shard`` is null, since under the law ``bytes`` one more shard
    moves any row.
    """
    return _packed(docs, shards, []).select(
        "doc_id", F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.lit(LAW).alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All rows and columns of ``docs`` as Parquet: a folder a shard, rows in order of ``slot``.

    Columns must be of kinds that can be grouped by, since they tell repeated rows apart. Those
    named shard or slot give way to the new ones.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    _packed(docs, shards, own).select(
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), *[F.col("_kept")[c].alias(c) for c in own]
    ).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def balance(packed: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return packed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
