"""Words of whole texts as arrays: spans and 64-bit hashes, computed for many documents at once.

A word is a run of bytes other than space and 0x09-0x0D; A to Z count as a to z. Texts are read
in their UTF-8 bytes, in which neither rule can meet part of another character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: whole texts that Spark hands to Python at once, unless the session names a number of its own
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; a bijection."""
    v = values.astype(_U64, copy=True)
    v ^= v >> _U64(30)
    v *= _U64(0xBF58476D1CE4E5B9)
    v ^= v >> _U64(27)
    v *= _U64(0x94D049BB133111EB)
    v ^= v >> _U64(31)
    return v


def tidy(compute: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``compute`` for mapInArrow, at whose end freed memory goes back to the system.

    Python workers live on between tasks, beside a JVM that keeps its heap; without this, what
    each kind of task once held adds up in an executor.
    """

    def run(batches):
        yield from compute(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Have the session hand ``BATCH_ROWS`` rows at once to Python, if it still has Spark's default.

    A batch is held by the JVM and by Python at the same time, and texts may be long, so this
    bounds their memory.
    """
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _BASE, dtype=_U64), np.full(n, _BASE_INVERSE, dtype=_U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, out=up), np.cumprod(down, out=down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    return _POWERS.of(n)


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]] if len(ends) else \
        np.zeros(0, np.uint8)
    return data, ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column that hold about ``most`` bytes of text each, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = raw_text(column)[1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _IN_WORD[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """Words of several texts: ``hash``, ``start`` and ``end`` in the bytes, and ``doc`` (text number)."""

    def __init__(self, column: pa.Array, spans: bool = False) -> None:
        self.data, self.offsets = raw_text(column)
        self.n_docs = len(self.offsets) - 1
        hashes, starts, ends = [], [], []
        at = 0
        while at < len(self.data):
            to = self._cut(at)
            piece = self.data[at:to]
            s, e = _spans(piece, self.offsets - at)
            hashes.append(_hash(_LOWER[piece], s, e))
            starts.append(s + at)
            if spans:
                ends.append(e + at)
            at = to
        none = np.zeros(0, dtype=np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, _U64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        #: words of text i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets, "left")

    def _cut(self, at: int, step: int = 4 * SLICE_BYTES) -> int:
        """End of the next piece of bytes, so that no word is cut and memory stays bounded."""
        end = at + step
        if end >= len(self.data):
            return len(self.data)
        spaces = np.flatnonzero(~_IN_WORD[self.data[at:end]])
        if len(spaces):
            return at + int(spaces[-1]) + 1
        edge = self.offsets[np.searchsorted(self.offsets, at, "right")]
        while end < edge:
            spaces = np.flatnonzero(~_IN_WORD[self.data[end:end + step]])
            if len(spaces):
                return min(edge, end + int(spaces[0]))
            end += step
        return int(edge)


def _hash(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span out of one running sum, then mixed with the length."""
    up, down = _POWERS.of(len(piece) + 1)
    total = np.zeros(len(piece) + 1, dtype=_U64)
    np.cumsum((piece.astype(_U64) + _U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))


_PLACES = mix(np.arange(1, 65, dtype=_U64)) | _U64(1)


def shingle_sets(words: Words, length: int) -> list[np.ndarray]:
    """For each text its distinct shingles as ascending hashes.

    A text with fewer words than ``length`` has its whole word sequence as its one shingle; one
    without words has none.
    """
    h, first = words.hash, words.first
    n = max(0, len(h) - length + 1)
    rolled = np.zeros(n, dtype=_U64)
    for i in range(length):
        rolled += h[i:i + n] * _PLACES[i]
    rolled = mix(rolled + _U64(length))
    out = []
    for i in range(words.n_docs):
        a, b = first[i], first[i + 1]
        if b - a >= length:
            out.append(np.unique(rolled[a:b - length + 1]))
        elif b > a:
            whole = (h[a:b] * _PLACES[:b - a]).sum(dtype=_U64) + _U64(b - a)
            out.append(mix(np.array([whole], dtype=_U64)))
        else:
            out.append(np.zeros(0, _U64))
    return out
