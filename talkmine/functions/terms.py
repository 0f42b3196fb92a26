"""Terms of many texts counted at once: arrays of words become counts, slots and vectors with Arrow and numpy.

Lower case and word borders are Spark's; only arrays of words come here, in slices of bounded length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: rows that are counted at once
SLICE_ROWS = 1000


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number and code of every word, and the words that the codes stand for; a null array has none."""
    coded = pc.dictionary_encode(pc.list_flatten(words))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), lengths), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _lists(rows: np.ndarray, values: pa.Array, words: pa.Array) -> pa.Array:
    """``values`` as one array per row of ``words``, null where that is null."""
    ends = np.searchsorted(rows, np.arange(len(words) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pc.is_null(words))


def _in_slices(compute: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def run(words: pa.Array) -> pa.Array:
        made = [compute(words.slice(i, SLICE_ROWS)) for i in range(0, len(words), SLICE_ROWS)]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return run


def counted(words: Column, term: str, count: str) -> Column:
    """Array of ``struct<term, count>``, in order of the terms, from an array of terms."""

    def compute(words: pa.Array) -> pa.Array:
        rows, codes, terms = _coded(words)
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        found, n = np.unique(rows * max(1, len(order)) + rank[codes], return_counts=True)
        at, which = np.divmod(found, max(1, len(order)))
        return _lists(at, pa.StructArray.from_arrays(
            [terms.take(pa.array(order[which])).cast(pa.string()), pa.array(n, pa.int64())], names=[term, count]), words)

    kind = pa.list_(pa.struct([(term, pa.string()), (count, pa.int64())]))
    return F.arrow_udf(_in_slices(compute, kind), f"array<struct<{term}: string, {count}: bigint>>")(words)


def _weights(terms: pa.Array, often: pa.Table) -> np.ndarray:
    """Weight of each term by ``often`` (term, idf), NaN for one that isn't there."""
    at = pc.index_in(terms.cast(pa.string()), value_set=often["term"].combine_chunks().cast(pa.string()))
    at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
    return np.append(often["idf"].to_numpy().astype(np.float64), np.nan)[at]


def _promising(groups: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Whether a score may be among the ``k`` highest of its group once rounded to six places; NaN always may."""
    keep = np.isnan(scores)
    some = np.flatnonzero(~keep)
    order = some[np.lexsort((-scores[some], groups[some]))]
    new = np.r_[True, np.diff(groups[order]) > 0][:len(order)]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.r_[begins, len(order)])
    last = scores[order[np.minimum(begins + k, begins + sizes) - 1]]
    least = np.repeat(np.where(sizes < k, -np.inf, last - 2e-6), sizes)
    keep[order] = scores[order] >= least
    return keep


def best_weighed(words: Column, often: pa.Table, k: int) -> Column:
    """Array of ``struct<term, tf, idf>`` of an array of terms: of those in ``often`` (term, idf) all that may be among
    the ``k`` highest of tf * idf, ties included, and all others, whose idf is null."""

    def compute(words: pa.Array) -> pa.Array:
        rows, codes, terms = _coded(words)
        found, n = np.unique(rows * max(1, len(terms)) + codes, return_counts=True)
        at, which = np.divmod(found, max(1, len(terms)))
        idf = _weights(terms, often)[which]
        keep = _promising(at, n * idf, k)
        at, which, n, idf = at[keep], which[keep], n[keep], idf[keep]
        return _lists(at, pa.StructArray.from_arrays(
            [terms.take(pa.array(which)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(idf, mask=np.isnan(idf))],
            names=["term", "tf", "idf"]), words)

    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("idf", pa.float64())]))
    return F.arrow_udf(_in_slices(compute, kind), "array<struct<term: string, tf: bigint, idf: double>>")(words)


def sentence_weights(words: Column, often: pa.Table, least_words: int) -> Column:
    """Array of ``struct<pos, total, n, rare>`` of an array of sentences, each an array of terms.

    Of a sentence of ``least_words`` terms or more, ``total`` and ``n`` are the sum of weights and the number of its terms in
    ``often`` (term, idf), ``rare`` are the others as ``struct<term, tf>``.
    """
    rare_kind = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def compute(words: pa.Array) -> pa.Array:
        sentences = pc.list_flatten(words)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sizes = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
        rows, codes, terms = _coded(sentences)
        found, n = np.unique(rows * max(1, len(terms)) + codes, return_counts=True)
        at, which = np.divmod(found, max(1, len(terms)))
        idf = _weights(terms, often)[which]
        known = ~np.isnan(idf)
        total = np.bincount(at[known], n[known] * idf[known], len(owner))
        count = np.bincount(at[known], n[known], len(owner)).astype(np.int64)
        others = np.bincount(at[~known], minlength=len(owner))
        asked = np.flatnonzero((sizes >= least_words) & (sizes > 0))
        keep = np.zeros(len(owner), dtype=bool)
        keep[asked] = True
        mine = ~known & keep[at]
        rare = pa.StructArray.from_arrays(
            [terms.take(pa.array(which[mine])).cast(pa.string()), pa.array(n[mine], pa.int64())], names=["term", "tf"])
        ends = np.r_[0, np.cumsum(others[asked])].astype(np.int32)
        return _lists(owner[asked], pa.StructArray.from_arrays(
            [pa.array(pos[asked], pa.int32()), pa.array(total[asked]), pa.array(count[asked]),
             pa.ListArray.from_arrays(pa.array(ends), rare)], names=["pos", "total", "n", "rare"]), words)

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("total", pa.float64()), ("n", pa.int64()), ("rare", pa.list_(rare_kind))]))
    return F.arrow_udf(_in_slices(compute, kind), """array<struct<pos: int, total: double, n: bigint,
        rare: array<struct<term: string, tf: bigint>>>>""")(words)


def _slots(words: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and weights of the unit vectors of words, by row and slot; empty words don't count.

    The slot of a word is the first 32 bits of its MD5, modulo the dimension.
    """
    rows, codes, terms = _coded(words)
    terms = terms.to_pylist()
    slots = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms], dtype=np.int64)
    said = np.array([t != "" for t in terms], dtype=bool)[codes] if len(terms) else np.zeros(0, dtype=bool)
    found, n = np.unique(rows[said] * dim + slots[codes[said]], return_counts=True)
    at, slot = np.divmod(found, dim)
    length = np.sqrt(np.bincount(at, n.astype(np.float64) ** 2, len(words)))
    return at, slot, n / length[at]


def hashed(words: Column, dim: int) -> Column:
    """Sparse unit vector of an array of words: array of ``struct<slot, weight>``, ordered by slot."""

    def compute(words: pa.Array) -> pa.Array:
        at, slot, weight = _slots(words, dim)
        return _lists(at, pa.StructArray.from_arrays(
            [pa.array(slot, pa.int64()), pa.array(weight, pa.float64())], names=["slot", "weight"]), words)

    kind = pa.list_(pa.struct([("slot", pa.int64()), ("weight", pa.float64())]))
    return F.arrow_udf(_in_slices(compute, kind), "array<struct<slot: bigint, weight: double>>")(words)


def hashed_dense(words: Column, dim: int) -> Column:
    """The same as a dense array of floats."""

    def compute(words: pa.Array) -> pa.Array:
        at, slot, weight = _slots(words, dim)
        out = np.zeros((len(words), dim), dtype=np.float32)
        out[at, slot] = weight
        ends = np.arange(0, len(words) * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pc.is_null(words))

    return F.arrow_udf(_in_slices(compute, pa.list_(pa.float32())), "array<float>")(words)
