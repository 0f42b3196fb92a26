"""Exact top-k inner products by a three-phase uniform threshold.

The score of a row is the sum of its entries in several score lists, one for each group of
dimensions. Phase one gathers the best entries of every list and, from the rows they belong to, a
score that k rows surely reach, with the least entry of each list. A row that reaches that cutoff
has, in some list, at least an equal part of what the cutoff exceeds the sum of the least
entries by. Phase two sends out the cutoffs and collects the entries that are large enough;
phase three scores their rows exactly. Queries and rows meet in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmine.llm.vector_dedup import usable
from talkmine.session import cut_lineage

LISTS = 4
ROWS, QUERIES = 4096, 1024
#: largest score, less what rounding in the bound may hide
MOST = 2.0 ** 63 * (1 - 2.0 ** -40)


def _packed(vectors: DataFrame, n: int, size: int, width: int) -> DataFrame:
    """Rows (row, vec_id, vector) in blocks of about ``size``: block, rows, ids, and one matrix."""
    count = max(1, -(-n // size))

    def pack(batches):
        rows, ids, parts = [], [], []
        for batch in batches:
            for i in range(len(batch)):
                rows.append(batch.column("row")[i].as_py())
                ids.append(batch.column("vec_id")[i].as_py())
                v = np.zeros(width, dtype=np.int64)
                own = batch.column("vector")[i].values.to_numpy()
                v[:len(own)] = own
                parts.append(v)
        for a in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[a:a + size]], pa.list_(pa.int64())), pa.array([ids[a:a + size]], pa.list_(pa.int64())),
                pa.array([np.stack(parts[a:a + size]).tobytes()], pa.binary())], names=["rows", "ids", "matrix"])

    packed = vectors.repartition(count).mapInArrow(pack, "rows array<long>, ids array<long>, matrix binary")
    packed = cut_lineage(packed.withColumn("first", F.element_at("rows", 1)))
    # only the blocks' first rows pass through one task, never what they hold
    numbers = packed.select("first").withColumn("block", F.row_number().over(Window.orderBy("first")) - 1)
    return cut_lineage(packed.join(F.broadcast(numbers), "first").drop("first"))


def _entries(queries, matrix, lists: int, width: int) -> tuple[np.ndarray, ...]:
    """Entries of each list for all queries (rows) and vectors of two blocks, exact.

    Products are made in floating point while every sum stays below 2**53, else in integers.
    """
    q = np.frombuffer(queries, np.int64).reshape(-1, width)
    x = np.frombuffer(matrix, np.int64).reshape(-1, width)
    top = max(1, width) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0))
    if top < 2 ** 53:
        q, x = q.astype(float), x.astype(float)
    return tuple(q[:, part] @ x[:, part].T for part in np.array_split(np.arange(width), lists))


def _own(batch, i: int, entries) -> np.ndarray:
    """Which entries belong to a query's own row."""
    rows = batch.column("rows")[i].values.to_numpy()
    return batch.column("q_rows")[i].values.to_numpy()[:, None] == rows[None, :]


def _gather(k: int, lists: int, width: int):
    """Phase one: per query of a pair of blocks the k-th best score among the rows that lead some
    list there (null if there are fewer), and the least entry of each list."""

    def compute(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = _entries(batch.column("q_matrix")[i].as_py(), batch.column("matrix")[i].as_py(), lists, width)
                own = _own(batch, i, parts)
                total = sum(parts)
                n_q, n = total.shape
                lead = np.zeros(total.shape, bool)
                for part in parts:
                    best = np.argpartition(np.where(own, part.min(), part), n - min(k, n), axis=1)[:, n - min(k, n):]
                    lead[np.arange(n_q)[:, None], best] = True
                lead &= ~own
                reached = np.where(lead, total.astype(float), -np.inf)
                kth = np.partition(reached, n - k, axis=1)[:, n - k] if n >= k else np.full(n_q, -np.inf)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("q_block")[i].as_py()] * n_q, pa.int64()),
                    pa.array(np.arange(n_q)),
                    pa.array([int(v) if v > -np.inf else None for v in kth], pa.int64()),
                    pa.array(list(np.stack([p.min(axis=1) for p in parts], axis=1).astype(np.int64)),
                             pa.list_(pa.int64()))], names=["q_block", "place", "cutoff", "least"])

    return compute


def _collect(k: int, lists: int, width: int):
    """Phases two and three: rows with a large enough entry in some list, their exact scores, and
    of those that reach the cutoff the k best here."""

    def compute(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = _entries(batch.column("q_matrix")[i].as_py(), batch.column("matrix")[i].as_py(), lists, width)
                own = _own(batch, i, parts)
                ids = batch.column("ids")[i].values.to_numpy()
                cutoff = batch.column("cutoffs")[i].values.to_numpy(zero_copy_only=False).astype(float)
                least = batch.column("leasts")[i].values.flatten().to_numpy().reshape(len(cutoff), lists).astype(float)
                share = (np.nan_to_num(cutoff, nan=-np.inf) - least.sum(axis=1)) / lists
                large = np.zeros(own.shape, bool)
                for j, part in enumerate(parts):
                    # half a unit lower: rounding here must not lose an entry
                    large |= part >= (least[:, j] + share)[:, None] - 0.5
                at_q, at = np.nonzero(large & ~own)
                exact = sum(part[at_q, at] for part in parts).astype(np.int64)
                enough = np.isnan(cutoff[at_q]) | (exact >= cutoff[at_q])
                at_q, at, exact = at_q[enough], at[enough], exact[enough]
                order = np.lexsort((ids[at], -exact, at_q))
                at_q, at, exact = at_q[order], at[order], exact[order]
                rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, "left")
                at_q, at, exact = at_q[rank < k], at[rank < k], exact[rank < k]
                yield pa.RecordBatch.from_arrays([
                    pa.array(batch.column("q_rows")[i].values.to_numpy()[at_q]),
                    pa.array(batch.column("q_ids")[i].values.to_numpy()[at_q]),
                    pa.array(ids[at]), pa.array(exact)], names=["q_row", "query_id", "vec_id", "score"])

    return compute


def top_scores(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of each query, all if fewer.

    ``embeddings`` has vec_id and embedding. Each component x counts as ``floor(scale * x)``, and
    the score is the inner product. Queries are the rows whose vec_id is divisible by ``every``,
    candidates all rows but the query's own; ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector, or a null or non-finite component take no part. Vectors of different
    length are compared as if the shorter ended in zeros. A row that repeats an id is a
    candidate of its own and, if divisible, a query of its own. Where the product of the longest
    vectors' lengths, which no score exceeds, doesn't fit a long, an ``OverflowError`` is raised.
    """
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    asks = F.col("vec_id") % every == 0
    queries = rows.filter(asks)
    length = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, width, n_q, longest, asked_longest = rows.agg(
        F.count("*"), F.max(F.size("vector")), F.count_if(asks), F.max(length), F.max(F.when(asks, length))).first()
    if n_q and math.sqrt(longest) * math.sqrt(asked_longest) > MOST:
        raise OverflowError(f"products of vectors of length {math.sqrt(longest):.3g} don't fit a long; take a smaller scale")
    width = max(1, width or 0)
    lists = min(lists, width)
    spark = embeddings.sparkSession
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = _packed(rows, n, ROWS, width)
    asked = _packed(queries, n_q, QUERIES, width).select(
        F.col("block").cast("long").alias("q_block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix"))
    places = blocks.count()

    def met(q: DataFrame) -> DataFrame:
        each = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
        return each.join(blocks, "block")

    gathered = met(asked).mapInArrow(_gather(k, lists, width), "q_block long, place long, cutoff long, least array<long>")
    bounds = gathered.groupBy("q_block", "place").agg(
        F.max("cutoff").alias("cutoff"), *[F.min(F.col("least")[j]).alias(f"l{j}") for j in range(lists)])
    bounds = bounds.groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct(
        "place", "cutoff", F.array(*[f"l{j}" for j in range(lists)]).alias("least")))).alias("b"))
    asked = asked.join(bounds, "q_block").select(
        "q_block", "q_rows", "q_ids", "q_matrix", F.col("b.cutoff").alias("cutoffs"), F.col("b.least").alias("leasts"))
    found = met(cut_lineage(asked)).mapInArrow(_collect(k, lists, width), "q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score from s)
select * from r where "rank" <= 20
"""
