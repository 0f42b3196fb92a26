"""A stored keyword index of posting blocks, searched with early stop, and its upkeep.

Documents are taken by length and cut into ranges; a block holds the postings of one term in one range,
with the largest term count and the least length in it, from which the most that a document there can
gain follows for any state of the corpus. A search reads these heads, scores the ranges that
promise most, and then only those that still promise as much as the ``k``-th best found.

Every batch is a segment. Segments of one size class are merged when there are ``MERGE`` of them,
so a term is in a number of folders that grows with the logarithm of the corpus. Removed documents
are noted, taken out of answers and counts at once, and dropped at the next merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkmine.functions.ranking import top_k
from talkmine.functions.text import tokens
from talkmine.operators.enrichment import term_counts
from talkmine.operators.search import _term_part, _term_weight, query_terms
from talkmine.session import cut_lineage, forget, fresh_dir
from talkmine.sources import manifest as m

#: documents of a range
RANGE = 128
#: documents whose blocks are made at once
AT_ONCE = 4096
#: segments of a size class that are merged into one of the next
MERGE = 4
#: ranges that a search scores first
FIRST = 16
#: removed documents that may be sent to every task
SMALL = 100_000
#: what rounding of scores may hide
_HALF = 5e-5


# --- writing -------------------------------------------------------------------------------

def _cut(docs: pa.Table, kinds: pa.Schema) -> pa.RecordBatch:
    """Blocks of documents (range, doc, doc_len, terms)."""
    docs = docs.combine_chunks()
    terms = docs["terms"].combine_chunks() if docs.num_rows else pa.array([], docs.schema.field("terms").type)
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    said = pc.list_flatten(terms)
    coded = pc.dictionary_encode(pc.struct_field(said, "term"))
    tf = pc.struct_field(said, "tf").to_numpy(zero_copy_only=False)

    def ranks(values: pa.Array) -> np.ndarray:
        order = pc.array_sort_indices(values) if values.null_count == 0 else pc.sort_indices(values, null_placement="at_start")
        place = np.empty(len(values), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(values))
        return place

    term = ranks(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else row
    ranged = docs["range"].to_numpy()
    long = pc.take(docs["doc_len"].combine_chunks(), pa.array(row)).to_numpy(zero_copy_only=False)
    doc = pc.dictionary_encode(docs["doc"].combine_chunks(), null_encoding="encode")
    doc_rank = ranks(doc.dictionary)[doc.indices.to_numpy(zero_copy_only=False)] if len(row) else row
    order = np.lexsort((long, tf, doc_rank[row], term, ranged[row])) if len(row) else row
    row, term, tf, long = row[order], term[order], tf[order], long[order]
    first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(ranged[row]) != 0)][:len(row)])
    postings = pa.StructArray.from_arrays(
        [pc.take(docs["doc"].combine_chunks(), pa.array(row)), pa.array(tf, pa.int64()), pa.array(long, pa.int64())],
        fields=list(kinds.field("postings").type.value_type))
    columns = [ranged[row[first]], pc.take(pc.struct_field(said, "term"), pa.array(order[first])),
               np.diff(np.r_[first, len(row)]), np.maximum.reduceat(tf, first) if len(first) else tf,
               np.minimum.reduceat(long, first) if len(first) else long,
               pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), postings)]
    return pa.RecordBatch.from_arrays(
        [c.cast(k.type) if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)


def blocks(docs: DataFrame, key: str = "chunk_id", text: str | None = None) -> DataFrame:
    """(range, term, n, most_tf, least_len, postings) of documents (key, doc_len, terms).

    ``terms`` are an array of struct<term, tf>, or made from ``text`` once documents lie in their ranges. A
    block has at most ``RANGE`` postings, and a range is within one task, so its blocks are made there:
    documents are shuffled, their postings aren't.
    """
    place = F.monotonically_increasing_id()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, "doc_len", key).sortWithinPartitions("doc_len", key).withColumn(
        "range", F.shiftleft(F.shiftright(place, 33), 33) + F.floor(place.bitwiseAND((1 << 33) - 1) / RANGE))
    terms = F.col("terms") if text is None else term_counts(tokens(F.col(text)))
    rows = ranged.select("range", F.col(key).alias("doc"), "doc_len", terms.alias("terms"))
    schema = T.StructType.fromDDL(f"""range long, term string, n long, most_tf long, least_len long,
        postings array<struct<doc: {rows.schema["doc"].dataType.simpleString()}, tf: long, doc_len: long>>""")
    kinds = to_arrow_schema(schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                now = pa.Table.from_batches([batch.slice(begin, AT_ONCE)])
                held = now if held is None else pa.concat_tables([held, now])
                # the last range may go on in the next rows
                ready = int(np.searchsorted(held["range"].to_numpy(), held["range"][-1].as_py()))
                if ready:
                    yield _cut(held.slice(0, ready), kinds)
                    held = held.slice(ready)
        if held is not None:
            yield _cut(held, kinds)

    return rows.mapInArrow(make, schema)


def _segment(docs: DataFrame, root: str, key: str, note: str = "", text: str | None = None) -> m.Folder:
    spark = docs.sparkSession
    # the borders of ranges are drawn from all rows first, so blocks are written as they are made, not made twice
    loose = m.store(blocks(docs, key, text), root, "loose")
    made = m.read(spark, root, [loose]).repartitionByRange("term", "range").sortWithinPartitions("term", "range")
    done = m.store(made, root, "blocks", note)
    forget(spark, f"{root}/{loose.folder}")
    return done


def _documents(chunks: DataFrame, key: str, text: str) -> DataFrame:
    words = chunks.select(key, tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").cast("long").alias("doc_len"), term_counts(F.col("w")).alias("terms"))


def add(chunks: DataFrame, root: str, key: str = "chunk_id", text: str = "chunk_text") -> None:
    """Add documents as one segment, then merge as far as size classes ask for it.

    Keys are unique and new; a batch that died before its commit is simply added again.
    """
    spark = chunks.sparkSession
    state = m.current(spark, root)
    docs = chunks.select(key, F.size(tokens(F.col(text))).cast("long").alias("doc_len"), F.col(text).alias("__text"))
    n, length = docs.agg(F.count("*"), F.sum("doc_len")).first()
    if n:
        m.commit(spark, root, state.having(_segment(docs, root, key, f"{n} {length or 0}", "__text")))
    merge(spark, root, key)


def remove(chunks: DataFrame, root: str, key: str = "chunk_id", text: str = "chunk_text") -> None:
    """Take out documents, given with the text they were added with."""
    spark = chunks.sparkSession
    docs = cut_lineage(_documents(chunks, key, text))
    n, length = docs.agg(F.count("*"), F.sum("doc_len")).first()
    if not n:
        return
    state = m.current(spark, root)
    less = docs.select(F.explode("terms").alias("p")).groupBy(F.col("p.term").alias("term")).agg(F.count("*").alias("n"))
    m.commit(spark, root, state.having(
        m.store(docs.select(F.col(key).alias("doc")), root, "removed", f"{-n} {-(length or 0)}"),
        m.store(less, root, "removed_terms")))


def _class(folder: m.Folder) -> int:
    """Size class of a segment: how often ``MERGE`` goes into its documents."""
    return int(math.log(max(1, int(folder.note.split()[0])), MERGE))


def merge(spark: SparkSession, root: str, key: str = "chunk_id") -> None:
    """Merge segments of one size class into one until each class has fewer than ``MERGE``.

    Blocks are read back into documents without those removed; a document that a removal names is
    no longer counted as removed once its segment is merged.
    """
    while True:
        state = m.current(spark, root)
        classes: dict[int, list[m.Folder]] = {}
        for segment in state.of("blocks"):
            classes.setdefault(_class(segment), []).append(segment)
        full = [c for c in sorted(classes) if len(classes[c]) >= MERGE]
        if not full:
            return
        old = classes[full[0]]
        rows = m.read(spark, root, old).select(F.explode("postings").alias("p"), "term").select("p.*", "term")
        removed = m.read(spark, root, state.of("removed"))
        kept, gone = rows, None
        if removed is not None:
            names = cut_lineage(rows.select("doc").distinct().join(removed.distinct(), "doc", "left_semi"))
            few = F.broadcast(names) if names.count() <= SMALL else names
            gone = cut_lineage(rows.join(few, "doc", "left_semi"))
            kept = rows.join(few, "doc", "left_anti")
        whole = fresh_dir(spark, "merged")
        kept.groupBy("doc", "doc_len").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms")).write.parquet(whole)
        docs = spark.read.parquet(whole)
        n = sum(int(f.note.split()[0]) for f in old)
        length = sum(int(f.note.split()[1]) for f in old)
        more: list[m.Folder] = []
        left = state.without(old)
        if gone is not None and not names.isEmpty():
            out = gone.select("doc", "doc_len").distinct().agg(F.count("*"), F.sum("doc_len")).first()
            n, length = n - out[0], length - out[1]
            still = removed.distinct().join(names, "doc", "left_anti")
            less = m.read(spark, root, state.of("removed_terms")).groupBy("term").agg(F.sum("n").alias("n")).join(
                gone.groupBy("term").agg(F.count("*").alias("back")), "term", "left").select(
                "term", (F.col("n") - F.coalesce("back", F.lit(0))).alias("n")).filter("n <> 0")
            before = [f.note.split() for f in state.of("removed")]
            note = f"{sum(int(a) for a, _ in before) + out[0]} {sum(int(b) for _, b in before) + out[1]}"
            left = left.without(state.of("removed") + state.of("removed_terms"))
            if note.split()[0] != "0":
                more = [m.store(still, root, "removed", note), m.store(less, root, "removed_terms")]
        m.commit(spark, root, left.having(*more, _segment(docs.withColumnRenamed("doc", key), root, key, f"{n} {length}")))
        forget(spark, whole)


# --- searching -----------------------------------------------------------------------------

@dataclass
class Found:
    """The best documents, how many blocks the query's terms have, and how many were read."""

    hits: DataFrame
    blocks: int
    read: int


def _live(spark: SparkSession, root: str, state: m.State) -> DataFrame | None:
    """Blocks of all segments with the number of their segment."""
    made = None
    for i, folder in enumerate(state.of("blocks")):
        rows = m.read(spark, root, [folder]).withColumn("segment", F.lit(i))
        made = rows if made is None else made.unionByName(rows)
    return made


def _scores(rows: DataFrame, idf: DataFrame, avg_len: float, k1: float, b: float, key: str) -> DataFrame:
    gain = F.col("idf") * _term_part(F.col("p.tf"), F.col("p.doc_len"), F.lit(avg_len), k1, b)
    return rows.withColumn("p", F.explode("postings")).join(F.broadcast(idf), "term").groupBy(
        F.col("p.doc").alias(key)).agg(F.round(F.sum(gain), 4).alias("score"))


def search(spark: SparkSession, root: str, query: str, k: int = 10, key: str = "chunk_id", k1: float = 1.2,
           b: float = 0.75) -> Found:
    """The ``k`` best documents as ``bm25_topk`` gives them, from few of the blocks.

    No document in a range gains more than the sum of its blocks' best, so a range that promises
    less than the ``k``-th best score found can't hold an answer. Ties are settled by key.
    """
    state, terms = m.current(spark, root), query_terms(query)
    live = _live(spark, root, state)
    none = Found(spark.createDataFrame([], f"{key} string, score double"), 0, 0)
    if live is None or not terms:
        return none
    notes = [f.note.split() for f in state.of("blocks") + state.of("removed")]
    docs, length = (sum(int(x[i]) for x in notes) for i in (0, 1))
    mine = live.filter(F.col("term").isin(terms))
    counts = mine.select("term", "n")
    less = m.read(spark, root, state.of("removed_terms"))
    if less is not None:
        counts = counts.unionByName(less.filter(F.col("term").isin(terms)).select("term", (-F.col("n")).alias("n")))
    # one row per query term
    idf = cut_lineage(counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0").select(
        "term", _term_weight(F.lit(docs), F.col("df")).alias("idf")))
    if not docs or idf.isEmpty():
        return none
    avg_len = length / docs
    most = F.col("idf") * _term_part(F.col("most_tf"), F.col("least_len"), F.lit(avg_len), k1, b)
    heads = cut_lineage(mine.select("segment", "range", "term", "most_tf", "least_len").join(F.broadcast(idf), "term").groupBy(
        "segment", "range").agg(F.sum(most).alias("promise"), F.count("*").alias("blocks")))
    removed = m.read(spark, root, state.of("removed"))
    if removed is not None:
        removed = removed.withColumnRenamed("doc", key).distinct()

    def scored(ranges: DataFrame) -> DataFrame:
        found = _scores(mine.join(F.broadcast(ranges) if ranges.count() <= SMALL else ranges, ["segment", "range"]),
                        idf, avg_len, k1, b, key)
        return found if removed is None else found.join(removed, key, "left_anti")

    order, total, first = [F.desc("promise"), "segment", "range"], heads.count(), max(FIRST, -(-2 * k // RANGE))
    while True:
        begun = cut_lineage(top_k(heads, order, first).select("segment", "range", "blocks"))
        best = top_k(scored(begun.drop("blocks")), [F.desc("score"), key], k)
        least = [r["score"] for r in best.collect()]
        if len(least) == k or first >= total:
            break
        first *= 4
    if len(least) < k:
        ranges = begun
    else:
        ranges = cut_lineage(heads.filter(F.col("promise") >= least[-1] - _HALF).select("segment", "range", "blocks"))
    hits = top_k(scored(ranges.drop("blocks")), [F.desc("score"), key], k)
    read = ranges.unionByName(begun).distinct().agg(F.sum("blocks")).first()[0]
    return Found(hits, heads.agg(F.sum("blocks")).first()[0], read)
