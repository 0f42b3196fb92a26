"""How filters interact: what each of them removes, at every place in every order.

Each document fails or passes each of five filters, so a part of the corpus is a contingency
tensor of 2 x 2 x 2 x 2 x 2 counts. Whatever an order of filters does at a step is a contraction
of that tensor: along each axis it takes the documents that pass, that fail, or all. Spark counts
the cells; one ``einsum`` for a batch of parts then gives all steps of all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine.llm.text import WORD_PATTERN

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: percent of words that differ, and percent of code points that are A to Z
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
ODD_SIGNS = r"[#$%&*|]"
#: what a cell counts: all documents, good ones, toxic ones
KINDS = ("n", "good", "toxic")
PARTS = 64

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails each of the four filters that look at nothing but itself."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [
        n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS, text.rlike(ODD_SIGNS)]


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic: one row for each labelled document; any of its rows may mark it."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell and the counts of ``KINDS``; bit i of a cell says that filter i is failed.

    Texts stay in their tasks: 32 bytes of digest say which are equal. A digest's first document
    is found by an aggregation, and documents meet it by (digest, doc_id), so the copies of one
    text, be they a third of all rows, are spread by their ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures(text))), F.lit(0))
    seen = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), own.alias("cell"),
        F.unhex(F.sha2(text, 256)).alias("digest"))
    counted = seen.groupBy("digest", "doc_id", "part", "cell").agg(F.count("*").alias("n"))
    # a document without an id has none before it and is before none
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    at_first = counted.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    last_bit = F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1 << 4)
    per_doc = at_first.select("doc_id", "part", (F.col("cell") + last_bit).alias("cell"), "n")
    marked = per_doc.groupBy("doc_id", "part", "cell").agg(F.sum("n").alias("n")).join(marks(labels), "doc_id", "left")
    return marked.groupBy("part", "cell").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _contractions() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) of every result row, and for each what to take along each axis: of the
    documents kept, removed, failing but removed before, and failing this filter only."""
    rows, chosen = [], []
    for order in permutations(range(len(FILTERS))):
        for step, own in enumerate(order):
            before = order[:step]
            kept = [_PASS if f == own or f in before else _ALL for f in range(len(FILTERS))]
            removed = [_FAIL if f == own else _PASS if f in before else _ALL for f in range(len(FILTERS))]
            failing = [_FAIL if f == own else _ALL for f in range(len(FILTERS))]
            alone = [_FAIL if f == own else _PASS for f in range(len(FILTERS))]
            rows.append(("".join(FILTERS[f] for f in order), step + 1))
            chosen.append([kept, removed, failing, alone])
    return rows, np.array(chosen, dtype=np.int64)


def contract(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Counts (part, row) of every step from tensors (part, 2, 2, 2, 2, 2, kind), axes A to E."""
    rows, chosen = _contractions()
    taken = np.einsum("pabcdek,rwa,rwb,rwc,rwd,rwe->prwk", tensors,
                      *[chosen[:, :, axis] for axis in range(len(FILTERS))], optimize=True)
    kept, removed, failing, alone = (taken[:, :, w] for w in range(4))
    out = {
        "kept": kept[..., 0], "removed": removed[..., 0], "redundant": failing[..., 0] - removed[..., 0],
        "unique_fails": alone[..., 0], "good_lost": removed[..., 1], "toxic_lost": removed[..., 2]}
    letters = np.array([order[step - 1] for order, step in rows])
    shapley = np.zeros_like(out["removed"])
    for letter in FILTERS:
        own = letters == letter
        shapley[:, own] = out["removed"][:, own].sum(axis=1, keepdims=True)
    return {**out, "shapley": shapley}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in NAMES)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, _ = _contractions()
    orders, steps = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS):
            piece = batch.slice(at, PARTS)
            flat = piece.column("counts").flatten().to_numpy(zero_copy_only=False)
            # a cell's lowest bit is filter A, so A is the last axis of the flat cells
            tensors = flat.reshape(piece.num_rows, *[2] * len(FILTERS), len(KINDS)).transpose(0, 5, 4, 3, 2, 1, 6)
            counts = contract(tensors)
            yield pa.RecordBatch.from_arrays([
                piece.column("part").take(pa.array(np.repeat(np.arange(piece.num_rows), len(rows)))),
                pa.concat_arrays([orders] * piece.num_rows), pa.concat_arrays([steps] * piece.num_rows),
                *[pa.array(counts[n].ravel()) for n in NAMES]], names=["part", "filter_order", "step", *NAMES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: what is kept after it and what it does.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. Parts are the sources;
    a null source is the part ``''``, together with sources that are empty. A null text counts as an
    empty one, which fails A. E compares whole texts with those of smaller ids in the whole table; rows that
    repeat an id are no smaller than each other, and a row without an id neither fails E nor makes others
    fail. Rows that repeat a document count as often as they occur; several labels of one document
    count once. A long text is one row of one task. An empty table gives no rows; other columns are ignored.
    ``shapley`` is a filter's removals summed over all orders, 120 times its Shapley value.
    """
    pivoted = cells(docs, labels).groupBy("part").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("cell") == cell, F.col(kind))), F.lit(0)).cast("long")
        for cell in range(1 << len(FILTERS)) for kind in KINDS]).alias("counts"))
    return pivoted.mapInArrow(_steps, SCHEMA)


def shapley_values(audited: DataFrame) -> DataFrame:
    """part, filter and its mean removals over all orders: the parts of all that is removed."""
    return audited.groupBy("part", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter")).agg(
        (F.max("shapley") / factorial(len(FILTERS))).alias("removals"))


ORACLE = r"""
with words as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') txt,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
facts as (
  select part, doc_id,
    len(ws) < 200 a, 100 * len(list_distinct(ws)) < 50 * len(ws) b,
    100 * len(regexp_extract_all(txt, '[A-Z]')) > 2 * length(txt) c, regexp_matches(txt, '[#$%&*|]') d,
    coalesce(doc_id > min(doc_id) over (partition by txt), false) e from words),
tagged as (
  select facts.*, coalesce(good, false) good, coalesce(toxic, false) toxic from facts left join (
    select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id) using (doc_id)),
cells as (
  select part, [a, b, c, d, e] f, count(*) n, count(*) filter (good) g, count(*) filter (toxic) t from tagged group by all),
letters as (select unnest([1, 2, 3, 4, 5]) i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select o, i step, o[i] own, o[1:i - 1] before from orders, letters),
done as (
  select part, o, step, own,
    sum(n) filter (not f[own] and not ahead) kept, sum(n) filter (f[own] and not ahead) removed,
    sum(n) filter (f[own] and ahead) redundant, sum(n) filter (f[own] and len(list_filter(f, lambda x: x)) = 1) unique_fails,
    sum(g) filter (f[own] and not ahead) good_lost, sum(t) filter (f[own] and not ahead) toxic_lost
  from (select *, len(list_filter(before, lambda x: f[x])) > 0 ahead from cells, steps) group by 1, 2, 3, 4)
select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') filter_order, step::int step,
  coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
  coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost,
  coalesce(toxic_lost, 0)::bigint toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, own))::bigint shapley from done
"""
