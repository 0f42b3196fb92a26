"""Vector, keyword and hybrid search over chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talkmine import fixed_values as fixed
from talkmine.functions.ranking import literal_table, places, skew_join, top_k
from talkmine.functions.text import tokens
from talkmine.functions.vectors import (
    best_of_block, cosine_to, top_of_partition, unit, unit_rows, with_direction,
)

# Query vectors up to this size are sent to every task; more are joined block by block.
BROADCAST_BYTES = 64 * 1024 * 1024
QUERY_BLOCK = 2048
VECTOR_BLOCK = 20_000


def vector_topk(vectors: DataFrame, query: Column, k: int = 8, key: str = "chunk_id",
                vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest by cosine to a ``query`` of length 1.

    ``vector_of`` gives one from a table, ``unit(F.lit([...]))`` from plain numbers.
    """
    return top_k(vector_scores(vectors, query, vector), [F.desc_nulls_last("score"), key], k)


def vector_scores(vectors: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    """Cosine of every vector to a ``query`` of length 1."""
    return vectors.withColumn("_query", query).withColumn(
        "score", F.round(cosine_to(F.col(vector), F.col("_query")), 6)).drop(vector, "_query")


def vector_of(vectors: DataFrame, key: str, value, vector: str = "embedding") -> Column:
    """The vector of one row, scaled to length 1, as a scalar subquery."""
    return vectors.filter(F.col(key) == value).select(unit(F.col(vector))).scalar()


def batch_search(
    queries: DataFrame, vectors: DataFrame, k: int = 8, query_id: str = "query_id", key: str = "chunk_id",
    vector: str = "embedding", skip_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact top ``k`` for each row of a query table: (query_id, key, score, rank).

    Vectors are scored in blocks with numpy, and each task keeps only its best ``k`` per
    query, so what is shuffled does not grow with the corpus. Query tables whose measured
    size fits ``broadcast_bytes`` go to every task; larger ones are cut into blocks that are
    joined with blocks of vectors. Both ways give the same rows. Vectors without a direction
    (NULL, all zero, or with a NULL or non-finite number) take no part.
    """
    asked = with_direction(queries, vector).select(F.col(query_id).alias("query_id"), F.col(vector).alias("query"))
    corpus = with_direction(vectors, vector).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    count, width = asked.agg(F.count("*"), F.max(F.size("query"))).first()
    if (count or 0) * (width or 0) * 8 <= broadcast_bytes:
        rows = asked.toPandas()
        if rows.empty:
            best = asked.sparkSession.createDataFrame([], schema)
        else:
            ids, matrix = rows["query_id"].to_numpy(), unit_rows(rows["query"].to_numpy())
            best = corpus.mapInArrow(top_of_partition(ids, matrix, k, skip_self), schema)
    else:
        best = _search_by_blocks(asked, corpus, count, k, skip_self, schema)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select(
        "query_id", F.col("id").alias(key), "score", "rank")


def _search_by_blocks(
    asked: DataFrame, corpus: DataFrame, count: int, k: int, skip_self: bool, schema: T.StructType
) -> DataFrame:
    total = corpus.count()
    query_blocks = -(-count // QUERY_BLOCK)
    vector_blocks = max(1, -(-total // VECTOR_BLOCK))

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("qb", block("query_id", query_blocks)).withColumn("vb", every(vector_blocks))
    right = corpus.withColumn("vb", block("id", vector_blocks)).withColumn("qb", every(query_blocks))

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return best_of_block(
            q["query_id"].to_numpy(), unit_rows(q["query"].to_numpy()),
            v["id"].to_numpy(), unit_rows(v["vector"].to_numpy()), k, skip_self)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(score, schema)


def vector_neighbors(vectors: DataFrame, k: int = 5, key: str = "chunk_id", vector: str = "embedding",
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` nearest other rows of every row."""
    return batch_search(
        vectors.withColumnRenamed(key, "query_id"), vectors, k, key=key, vector=vector, skip_self=True,
        broadcast_bytes=broadcast_bytes)


def similar_pairs(
    claims: DataFrame, vectors: DataFrame, days: int = 30, least: float = 0.7, block: int = 2000,
    key: str = "claim_id", vector: str = "embedding",
) -> DataFrame:
    """Claim pairs on one topic, more than ``days`` apart, with cosine above ``least``.

    A topic is cut into blocks of about ``block`` claims and block is met with block, so a
    topic with a third of all claims is spread over many tasks. Only true pairs leave a task.
    """
    rows = claims.filter(F.col("topic").isNotNull() & F.col("claim_date").isNotNull()).join(
        with_direction(vectors, vector).select(key, F.col(vector).alias("v")), key).select(
        "topic", F.col(key).alias("id"), F.unix_date("claim_date").alias("day"), "v")
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / block).cast("int"))
    cut = skew_join(rows, sizes, "topic", "n").withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tile = ["topic", "i", "j"]
    columns = [*tile, "id", "day", "v"]
    earlier = cut.withColumn("j", other).withColumnRenamed("own", "i").select(*columns)
    later = cut.withColumn("i", other).withColumnRenamed("own", "j").select(
        *[F.col(c).alias(c) for c in columns])
    key_type = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("topic", rows.schema["topic"].dataType), T.StructField("original_claim_id", key_type),
        T.StructField("evolved_claim_id", key_type), T.StructField("time_delta_days", T.LongType()),
        T.StructField("similarity_score", T.DoubleType())])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        scores = unit_rows(a["v"].to_numpy()) @ unit_rows(b["v"].to_numpy()).T
        gap = b["day"].to_numpy(dtype=np.int64)[None, :] - a["day"].to_numpy(dtype=np.int64)[:, None]
        x, y = np.nonzero((scores > least) & (gap > days))
        return pd.DataFrame({
            "topic": a["topic"].to_numpy()[x], "original_claim_id": a["id"].to_numpy()[x],
            "evolved_claim_id": b["id"].to_numpy()[y], "time_delta_days": gap[x, y],
            "similarity_score": np.round(scores[x, y], 6)})

    return earlier.groupBy(*tile).cogroup(later.groupBy(*tile)).applyInPandas(meet, schema)


# --- keywords ----------------------------------------------------------------------------

def corpus_stats(docs: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Number of documents and their mean length in tokens."""
    return docs.agg(F.count("*").alias("docs"), F.avg(F.size(tokens(F.col(text)))).alias("avg_len"))


def query_terms(query: str) -> list[str]:
    import re
    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})


def _term_weight(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def _term_part(tf: Column, doc_len: Column, avg_len: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def bm25_scan(docs: DataFrame, terms: list[str], key: str, text: str, k1: float = 1.2, b: float = 0.75,
              where: Column | None = None) -> DataFrame:
    """Relevance of each document without an index: one scan for figures, one to score.

    Nothing is shuffled but one row of figures per task. ``where`` narrows what is scored; the
    figures are those of all documents.
    """
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    words = docs.select(key, wanted.alias("wanted"), tokens(F.col(text)).alias("w"))
    figures = words.agg(F.struct(
        F.count("*").alias("docs"), F.avg(F.size("w")).alias("avg_len"),
        *[F.count_if(F.array_contains("w", t)).alias(f"df{i}") for i, t in enumerate(terms)])).scalar()
    hits = words.select(
        key, F.size("w").alias("doc_len"), F.filter("w", lambda w: w.isin(terms)).alias("h"),
        "wanted").filter(F.col("wanted") & (F.size("h") > 0)).withColumn("f", figures)
    f = F.col("f")

    def part(i: int, term: str) -> Column:
        tf = F.size(F.filter("h", lambda w: w == term))
        return _term_weight(f["docs"], f[f"df{i}"]) * _term_part(tf, F.col("doc_len"), f["avg_len"], k1, b)

    total = sum((part(i, t) for i, t in enumerate(terms)), F.lit(0.0))
    return hits.select(key, F.round(total, 4).alias("score"))


def bm25_indexed(rows: DataFrame, stats: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Relevance of each document from the posting rows of the query terms."""
    docs, avg_len = stats.select("docs").scalar(), stats.select("avg_len").scalar()
    # One row per query term, so this side is as small as the query.
    idf = rows.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", _term_weight(docs, F.col("df")).alias("idf"))
    part = F.col("idf") * _term_part(F.col("tf"), F.col("doc_len"), avg_len, k1, b)
    return rows.join(F.broadcast(idf), "term").groupBy(key).agg(F.round(F.sum(part), 4).alias("score"))


def bm25_topk(docs: DataFrame, query: str, k: int | None = 10, key: str = "chunk_id", text: str = "chunk_text",
              index: DataFrame | None = None, stats: DataFrame | None = None,
              where: Column | None = None) -> DataFrame:
    """The ``k`` most relevant documents, from the text itself or from a stored index.

    ``where``, a condition on ``docs``, narrows the search before the ranking, so the ``k`` are those
    of the documents that meet it. Without ``k`` all that hold a term.
    """
    terms = query_terms(query)
    if index is None:
        scores = bm25_scan(docs, terms, key, text, where=where)
    else:
        stats = corpus_stats(docs, text) if stats is None else stats
        scores = bm25_indexed(index.filter(F.col("term").isin(terms)), stats, key)
        if where is not None:
            scores = scores.join(docs.filter(where).select(key), key, "left_semi")
    return scores if k is None else top_k(scores, [F.desc("score"), key], k)


def hybrid_topk(
    by_vector: DataFrame, by_keyword: DataFrame, k: int = 10, key: str = "chunk_id", smooth: int = 60
) -> DataFrame:
    """Reciprocal rank fusion of two lists (each with ``score`` and unique keys), by a threshold.

    A list's first ``k`` score at least ``1 / (smooth + k)``. A document below place ``smooth + 2k``
    in both scores less, so only those above it in one list can be among the best ``k``. Their
    places in the other list, however far down, are counted in one pass; no list is sorted or cut.
    """
    depth = smooth + 2 * k
    lists = {"vector_rank": by_vector.select(key, F.col("score").cast("double").alias("score")),
             "keyword_rank": by_keyword.select(key, F.col("score").cast("double").alias("score"))}
    heads = {name: top_k(rows, [F.desc_nulls_last("score"), key], depth).collect() for name, rows in lists.items()}
    found: dict = {row[key]: {} for rows in heads.values() for row in rows}
    for name, rows in heads.items():
        for place, row in enumerate(rows, 1):
            found[row[key]][name] = place
    for name, rows in lists.items():
        if len(heads[name]) < depth:
            continue  # the whole list was read
        missing = [i for i, ranks in found.items() if name not in ranks]
        seen = [(row["score"], row[key]) for row in rows.filter(F.col(key).isin(missing)).collect()] if missing else []
        for (_, i), place in zip(seen, places(rows, "score", key, seen) if seen else []):
            found[i][name] = place
    worth = {i: round(sum(1.0 / (smooth + r) for r in ranks.values()), 8) for i, ranks in found.items()}
    best = sorted(found, key=lambda i: (-worth[i], i))[:k]
    kind = lists["vector_rank"].schema[key].dataType.simpleString()
    return literal_table(by_vector.sparkSession, [
        (i, found[i].get("vector_rank"), found[i].get("keyword_rank"), worth[i]) for i in best],
        f"{key} {kind}, vector_rank long, keyword_rank long, score double")


def result_view(hits: DataFrame, chunks: DataFrame, preview: int | None = None) -> DataFrame:
    """Hits with the columns a reader sees; ``preview`` shortens the shown text."""
    shown = hits.select("chunk_id", "score").join(chunks.select(*fixed.RESULT_COLUMNS), "chunk_id")
    if preview is not None:
        shown = shown.withColumn("chunk_text", F.left("chunk_text", F.lit(preview)))
    return shown.select(*fixed.RESULT_COLUMNS, "score")


# --- related episodes ----------------------------------------------------------------------

def mean_vectors(vectors: DataFrame, by: str = "video_id", vector: str = "embedding") -> DataFrame:
    """Mean vector per group; sums are combined on the map side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    doubles = array_to_vector(F.col(vector).cast("array<double>"))
    return vectors.groupBy(by).agg(Summarizer.mean(doubles).alias("m")).select(
        by, vector_to_array("m").alias(vector))


def related_episodes(vectors: DataFrame, video_id, k: int = 5, by: str = "video_id") -> DataFrame:
    """Episodes whose mean vector is nearest to that of one episode."""
    means = mean_vectors(vectors, by)
    return vector_topk(means.filter(F.col(by) != video_id), vector_of(means, by, video_id), k, key=by)


def related_by_topic(claims: DataFrame, video_id: str, k: int = 5) -> DataFrame:
    """Episodes that share most topics and speakers with one episode."""
    links = claims.select("video_id", F.explode(F.array(
        F.concat(F.lit("topic:"), "topic"), F.concat(F.lit("person:"), "speaker"))).alias("link")).distinct()
    own = links.filter(F.col("video_id") == video_id).select("link")
    groups = links.filter(F.col("video_id") != video_id).join(own, "link", "left_semi").groupBy(
        "video_id").agg(F.count("*").alias("shared"))
    return top_k(groups, [F.desc("shared"), "video_id"], k)
