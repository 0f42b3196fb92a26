"""Language identification of mixed text: script ranges, word scores and a Viterbi path.

Each word is scored by character n-grams per language. Only languages written in the script of
a word are candidates for it. A path through the words of a text that pays for each change of
language labels its spans; the language with most letters is the text's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmine.llm.text import SLICE_BYTES, mix, powers, slices, tidy

ORDERS = (1, 2, 3, 4)
CELLS = 1 << 16
#: words whose n-grams are held at once
PIECE = 20_000
SMOOTHING = 0.5
#: what a change of language costs, in natural logarithms
SWITCH = 12.0
#: a language is a candidate for a script in which at least this share of its letters is
IN_SCRIPT = 0.01
#: first code points of ranges, each up to the next; fixed values of the Unicode block list
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower case by code point; characters that become several stay."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


class LetterWords:
    """Runs of letters in several texts: first and last code point, text number and script."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\x00".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.zeros(len(self.points) + 2, dtype=np.int8)
        inside[1:-1] = _letters()[self.points]
        self.points = _lower()[self.points]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.length = self.end - self.start
        self.first = np.searchsorted(self.start, offsets)
        at = np.searchsorted(np.array([p for p, _ in SCRIPTS]), self.points[self.start], "right") - 1
        self.script = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])[at]
        self._total = None

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """An example of each different word, and for each word the number of its example."""
        _, example, which = np.unique(self.keys(self.start, self.end), return_index=True, return_inverse=True)
        return example, which

    def keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the code points of each span."""
        up, down = powers(len(self.points))
        if self._total is None:
            self._total = np.zeros(len(self.points) + 1, dtype=np.uint64)
            np.add(self.points, 1, out=self._total[1:])
            self._total[1:] *= up
            np.cumsum(self._total, out=self._total)
        return mix((self._total[end] - self._total[start]) * down[start] + (end - start).astype(np.uint64))

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every n-gram of the given words, with the place of its word among them."""
        length = self.length[words] + 2
        at = np.cumsum(length) - length
        padded = np.zeros(int(length.sum()), dtype=np.uint64)
        inner = np.ones(len(padded), bool)
        inner[at] = inner[at + length - 1] = False
        spread = np.repeat(self.start[words] - at - 1, length) + np.arange(len(padded))
        padded[inner] = self.points[spread[inner]]
        owner = np.repeat(np.arange(len(words)), length)
        cells, owners = [], []
        code = np.zeros(len(padded), dtype=np.uint64)
        for n in ORDERS:
            code = (code[:len(padded) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + padded[n - 1:] + np.uint64(n)
            same = owner[:len(code)] == owner[n - 1:]
            if n == 1:
                same &= inner
            value = code[same] * np.uint64(0xBF58476D1CE4E5B9)
            cells.append(((value ^ (value >> np.uint64(29))) % np.uint64(CELLS)).astype(np.int64))
            owners.append(owner[:len(code)][same])
        return np.concatenate(cells), np.concatenate(owners)

    def gram_counts(self, words: np.ndarray) -> np.ndarray:
        """How often each cell is met among the n-grams of the given words."""
        out = np.zeros(CELLS, dtype=np.int64)
        for a in range(0, len(words), PIECE):
            out += np.bincount(self.grams(words[a:a + PIECE])[0], minlength=CELLS)
        return out


def train(labelled: DataFrame) -> dict:
    """Model out of all rows of ``labelled`` (text, lang); null langs and texts are left out.

    Tasks count n-grams and letters per script in cells, of which each language has a fixed
    number, and the sums are what the driver reads. Without a row the model has no language.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            text = batch.column("text")
            for a, b in slices(text, 2 * SLICE_BYTES):
                own = lang[a:b]
                words = LetterWords(text.slice(a, b - a).to_pylist())
                for name in set(own):
                    mine = np.flatnonzero((own == name)[words.doc])
                    have = totals.setdefault(name, np.zeros(CELLS + len(SCRIPT_NAMES)))
                    if len(mine):
                        have[:CELLS] += words.gram_counts(mine)
                        have[CELLS:] += np.bincount(
                            words.script[mine], words.length[mine], minlength=len(SCRIPT_NAMES))
        for name, have in totals.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at])],
                names=["lang", "cell", "n"])

    counted = labelled.select("text", "lang").filter("lang is not null and text is not null").mapInArrow(
        tidy(count), "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), CELLS + len(SCRIPT_NAMES)))
    counts[table["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(dtype=int),
           table["cell"].to_numpy()] = table["n"].to_numpy()
    grams, scripts = counts[:, :CELLS] + SMOOTHING, counts[:, CELLS:]
    return {"langs": langs, "grams": np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32),
            "scripts": (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= IN_SCRIPT).T}


def word_scores(words: LetterWords, model: dict) -> np.ndarray:
    """Score of each word in each language; a language not written in its script can't have it."""
    example, which = words.distinct()
    n_langs = len(model["langs"])
    scores = np.zeros((len(example), n_langs))
    for a in range(0, len(example), PIECE):
        cells, owner = words.grams(example[a:a + PIECE])
        for lang in range(n_langs):
            scores[a:a + PIECE, lang] = np.bincount(
                owner, model["grams"][cells, lang], minlength=len(example[a:a + PIECE]))
    written = model["scripts"][words.script[example]]
    unknown = ~written.any(axis=1)
    written[unknown] = True
    return np.where(written, scores, -1e6)[which]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best path of languages through the words of each text, all texts a word at a time.

    ``first[i]`` is the first word of text i. From any language one may go to any other for
    ``penalty``, so only the best one is worth leaving. Texts are taken longest first, so those
    that still go on are always the first ones.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return np.zeros(len(scores), np.int64)
    size, begin = size[order], first[:-1][order]
    came = np.zeros(scores.shape, dtype=np.int16)
    best = scores[begin].copy()
    every = np.arange(scores.shape[1], dtype=np.int16)
    alive = len(order) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1), "left")
    for t in range(1, size[0]):
        n = alive[t]
        at = begin[:n] + t
        top = best[:n].argmax(axis=1)
        from_top = best[np.arange(n), top][:, None] - penalty
        stay = best[:n] >= from_top
        came[at] = np.where(stay, every, top[:, None])
        best[:n] = np.where(stay, best[:n], from_top) + scores[at]
    path = np.zeros(len(scores), dtype=np.int64)
    state = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        path[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return path


def _of_texts(texts: list[str], model: dict) -> tuple[LetterWords, np.ndarray, list, np.ndarray]:
    words = LetterWords(texts)
    n = len(model["langs"])
    if not n or not len(words.start):
        return words, np.zeros(len(words.start), np.int64), ["und"] * len(texts), np.zeros(len(texts))
    path = viterbi(word_scores(words, model), words.first)
    share = np.bincount(words.doc * n + path, words.length, minlength=n * len(texts)).reshape(-1, n)
    total = share.sum(axis=1)
    lang = [model["langs"][i] if t else "und" for i, t in zip(share.argmax(axis=1), total)]
    return words, path, lang, share.max(axis=1) / np.maximum(total, 1)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language) and spans of every whole text.

    ``spans`` lists (lang, letters) in order, one for each stretch of words with one language.
    Null texts and those without a letter are ``und`` with score 0 and no span, and so is
    everything if nothing was learned. Ties go to the language that sorts first. Rows that
    repeat give repeated rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        for batch in batches:
            text = batch.column("text").fill_null("")
            for a, b in slices(text, 2 * SLICE_BYTES):
                words, path, lang, score = _of_texts(text.slice(a, b - a).to_pylist(), box.value)
                spans = []
                for i in range(b - a):
                    own, size = path[words.first[i]:words.first[i + 1]], words.length[words.first[i]:words.first[i + 1]]
                    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
                    names = box.value["langs"]
                    spans.append([] if lang[i] == "und" else [
                        {"lang": names[own[c]], "letters": int(n)} for c, n in zip(cut, np.add.reduceat(size, cut))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())])))],
                    names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(compute), "doc_id long, lang_pred string, score double, spans array<struct<lang: string, letters: long>>")


def keep_known(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with at least ``least`` of their letters in one language."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def compute(batches):
        for batch in batches:
            text = batch.column("text").fill_null("")
            for a, b in slices(text, 2 * SLICE_BYTES):
                _, _, lang, score = _of_texts(text.slice(a, b - a).to_pylist(), box.value)
                yield batch.slice(a, b - a).select(columns).filter(
                    pa.array([name != "und" and s >= least for name, s in zip(lang, score)]))

    return docs.mapInArrow(tidy(compute), docs.schema)


def fold(doc_id, parts: int):
    """crc32 of the id as text modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def learn_from(docs: DataFrame) -> dict:
    """Model of the rows outside the held-out fold."""
    return train(docs.filter(fold(F.col("doc_id"), 3) != 1))


