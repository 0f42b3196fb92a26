"""Topics, entities, summaries and vectors computed from the text itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmine.functions.ranking import top_k
from talkmine.functions.terms import best_weighed, counted, hashed, hashed_dense, sentence_weights
from talkmine.functions.text import NOT_IN_WORD
from talkmine.session import stored


#: two or more capitalised words of any script
NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"
#: terms that may be sent to every task
FREQUENT = 100_000


def term_counts(terms: Column) -> Column:
    """Array of ``struct<term, tf>`` from an array of terms, inside the row."""
    return counted(terms, "term", "tf")


def long_tokens(text: Column, least: int = 3) -> Column:
    return F.filter(F.split(F.lower(text), NOT_IN_WORD), lambda t: F.length(t) >= least)


def postings(docs: DataFrame, key: str = "chunk_id", text: str = "chunk_text",
             terms: list[str] | None = None, least: int = 1) -> DataFrame:
    """(term, key, tf, doc_len) rows; with ``terms`` only those are unfolded."""
    words = docs.select(key, long_tokens(F.col(text), least).alias("w"))
    chosen = F.col("w") if terms is None else F.filter("w", lambda t: t.isin(list(terms)))
    return words.select(
        key, F.size("w").cast("long").alias("doc_len"), F.explode(term_counts(chosen)).alias("p")
    ).select("p.term", key, "p.tf", "doc_len")


def term_weights(docs: DataFrame, text: str = "chunk_text", least: int = 1) -> DataFrame:
    """(term, df, idf) with idf = ln(number of documents / documents with the term)."""
    total = docs.agg(F.count("*")).scalar()
    seen = docs.select(F.explode(F.array_distinct(long_tokens(F.col(text), least))).alias("term"))
    return seen.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(total / F.col("df")))


def _by_frequency(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights (term, df, idf) of frequent terms and of rarer ones.

    Terms with more than one in ``FREQUENT`` of all rows are fewer than that, whatever the texts, so they may be
    sent to every task. None of the others has many rows.
    """
    weights = stored(weights)
    total = weights.agg(F.sum("df")).first()[0] or 0
    frequent = F.col("df") * FREQUENT > total
    return weights.filter(frequent), weights.filter(~frequent)


def _sent(often: DataFrame) -> pa.Table:
    """Frequent terms and their weights for the tasks; fewer than ``FREQUENT`` rows."""
    return often.select("term", F.col("idf").cast("double").alias("idf")).toArrow()


def _with_rarer(rows: DataFrame, seldom: DataFrame, asked: Column) -> DataFrame:
    """All ``rows``, with the ``df`` and ``idf`` that ``seldom`` has for the term of those ``asked`` for, else null.

    The rows are made once. Those not asked for carry a hash of the whole row, so they spread over all tasks.
    """
    place = F.when(asked, F.xxhash64("term")).otherwise(F.xxhash64(*rows.columns))
    return rows.withColumn("_place", place).join(
        seldom.select("term", "df", "idf", F.xxhash64("term").alias("_place")), ["_place", "term"], "left").drop("_place")


def weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with a term, and what ``weights`` (term, df, idf) say of it.

    Frequent terms are sent to every task, so that nearly all rows stay beside the others of their text.
    Only rows of rarer terms, none of which has many, are shuffled.
    """
    often, seldom = _by_frequency(weights)
    often = F.broadcast(often)
    found = rows.join(often, "term")
    if seldom.isEmpty():
        return found
    rest = rows.join(often.select("term"), "term", "left_anti").join(seldom, "term")
    return found.unionByName(rest)


def tfidf_topics(chunks: DataFrame, k: int = 5, least: int = 4, weights: DataFrame | None = None) -> DataFrame:
    """The ``k`` terms of each chunk with the highest tf * idf, by these chunks or by stored ``weights``.

    A text is read once: its frequent terms are weighed and cut to the best beside it, and only these are
    shuffled, with its rare terms.
    """
    often, seldom = _by_frequency(term_weights(chunks, least=least) if weights is None else weights)
    words = long_tokens(F.col("chunk_text"), least)
    rows = chunks.select("chunk_id", F.explode(best_weighed(words, _sent(often), k)).alias("p")).select(
        "chunk_id", "p.term", "p.tf", F.col("p.idf").alias("known"))
    if seldom.isEmpty():
        weighted = rows.withColumnRenamed("known", "idf")
    else:
        weighted = _with_rarer(rows, seldom, F.col("known").isNull()).withColumn("idf", F.coalesce("known", "idf"))
    scored = weighted.filter(F.col("idf").isNotNull()).withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    ranks = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select(
        "chunk_id", F.col("term").alias("topic"), "tf", "score", "rank")


def cap_entities(chunks: DataFrame) -> DataFrame:
    """Runs of two or more capitalised words per chunk, with counts."""
    found = F.regexp_extract_all("chunk_text", F.lit(NAME), F.lit(0))
    return chunks.select("chunk_id", F.explode(term_counts(found)).alias("e")).select(
        "chunk_id", F.col("e.term").alias("entity"), F.col("e.tf").alias("mentions"))


def top_entities(entities: DataFrame, k: int = 25) -> DataFrame:
    groups = entities.groupBy("entity").agg(
        F.sum("mentions").alias("mentions"), F.count("*").alias("chunks"))
    return top_k(groups, [F.desc("mentions"), "entity"], k)


def sentences_in(text: str) -> Column:
    """Sentences of a text column, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda p: F.trim(p)),
                    lambda s: s != "")


def chunk_sentences_of(chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_window, pos, sentence) for each sentence of each chunk."""
    return chunks.select("video_id", "chunk_window", F.posexplode(sentences_in("chunk_text")).alias("pos", "sentence"))


def extract_summary(chunks: DataFrame, sentences: int = 3, least_words: int = 5,
                    weights: DataFrame | None = None) -> DataFrame:
    """The sentences with the highest mean term weight, in their original order.

    A text is read once to weigh its sentences by frequent terms beside it; their sums and rare terms are
    shuffled. Winners come to their chunk as one row and are cut out of its text there.
    """
    place = ["video_id", "chunk_window", "pos"]
    often, seldom = _by_frequency(term_weights(chunks, least=3) if weights is None else weights)
    words = F.transform(sentences_in("chunk_text"), lambda s: long_tokens(s))
    made = sentence_weights(words, _sent(often), least_words)
    # exploded where it is made: else a filter on its size is planned below, which makes it a second time
    rows = chunks.select("video_id", "chunk_window", F.explode(made).alias("s")).select("video_id", "chunk_window", "s.*")
    if seldom.isEmpty():
        # "rare" is named, since a generator whose fields aren't all used isn't planned with a Python function
        parts = rows.filter(F.size("rare") >= 0).select(*place, "total", "n")
    else:
        plain = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"))
        parts = rows.withColumn("p", F.explode(F.concat(F.array(plain), "rare"))).select(
            *place, "p.*", F.when(F.col("p.term").isNull(), F.col("total")).alias("total"),
            F.when(F.col("p.term").isNull(), F.col("n")).alias("n"))
        met = _with_rarer(parts, seldom, F.col("term").isNotNull()).filter(F.col("term").isNull() | F.col("idf").isNotNull())
        parts = met.select(*place, F.coalesce("total", F.col("tf") * F.col("idf")).alias("total"), F.coalesce("n", "tf").alias("n"))
    summed = parts.groupBy(*place).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    scored = summed.filter("n > 0").select(*place, F.round(F.col("total") / F.col("n"), 6).alias("score"))
    ranks = Window.partitionBy("video_id").orderBy(F.desc("score"), "chunk_window", "pos")
    best = scored.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= sentences)
    chosen = best.groupBy("video_id", "chunk_window").agg(F.collect_list(F.struct("pos", "score")).alias("won"))
    texts = chunks.select("video_id", "chunk_window", sentences_in("chunk_text").alias("s"))
    cut = texts.join(chosen, ["video_id", "chunk_window"]).select("video_id", "chunk_window", F.transform(
        "won", lambda w: F.struct(w["pos"].alias("pos"), w["score"].alias("score"), F.get(F.col("s"), w["pos"]).alias("sentence")))
        .alias("won"))
    return cut.select("video_id", "chunk_window", F.explode("won").alias("w")).select("video_id", "chunk_window", "w.*").groupBy(
        "video_id").agg(
        F.expr("listagg(sentence, ' ') within group (order by chunk_window, pos)").alias("episode_summary"),
        F.max("score").alias("best_score"))


def hash_weights(text: Column, dim: int = 768) -> Column:
    """Sparse unit vector of a text: array of ``struct<slot, weight>``, ordered by slot."""
    return hashed(F.split(F.lower(text), NOT_IN_WORD), dim)


def hash_embed(chunks: DataFrame, dim: int = 768) -> DataFrame:
    """Chunks with a hashed bag-of-words ``embedding``; vectors of a model fit the same column."""
    return chunks.withColumn("embedding", hashed_dense(F.split(F.lower("chunk_text"), NOT_IN_WORD), dim))
