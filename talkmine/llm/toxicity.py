"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicon voters hold some words and beginnings of words each, learned from labelled rows; pattern
voters look at how a text is written. How they vote on all documents, without labels, tells a two-class model how
accurate each is and which of them say the same thing. Its posterior labels train a linear
classifier on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmine.llm.quality import _descend, _sigmoid, bounded, sampled
from talkmine.llm.langid import LetterWords
from talkmine.llm.text import SLICE_BYTES, raw_text, slices

#: voters with a lexicon, and entries that their lexicons hold together
LEXICONS, ENTRIES = 12, 384
#: an entry is a whole word or its first so many letters
BEGINNINGS = (4, 5, 6, 7)
#: labelled rows from which lexicons are learned, rows on which the classifier is fitted
LABELLED, SAMPLE = 20_000, 20_000
#: an entry was seen in so many labelled texts, at least this share of them toxic
LEAST_SEEN, LEAST_SHARE = 4, 0.75
PATTERNS = ("shouting", "exclaiming")
N_VOTERS = LEXICONS + len(PATTERNS)

class Entries:
    """Which words and beginnings of words each of several texts holds."""

    def __init__(self, column: pa.Array) -> None:
        words = LetterWords(column.fill_null("").to_pylist())
        self.n_docs = len(column)
        example, which = words.distinct()
        start, length = words.start[example], words.length[example]
        shown = [words.keys(start, start + length)]
        for n in BEGINNINGS:
            shown.append(np.where(length > n, words.keys(start, start + np.minimum(n, length)), shown[0]))
        #: keys of each different word, and which texts hold which words (each once)
        self.keys = np.stack(shown, axis=1)
        held = np.unique(words.doc * max(len(example), 1) + which)
        self.doc, self.word = held // max(len(example), 1), held % max(len(example), 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each (text, key) once: text numbers and keys."""
        key, at = np.unique(self.keys, return_inverse=True)
        at = at.reshape(self.keys.shape)
        held = np.unique((self.doc[:, None] * max(len(key), 1) + at[self.word]).ravel())
        return held // max(len(key), 1), key[held % max(len(key), 1)] if len(key) else key

    def presence(self, vocabulary: np.ndarray) -> np.ndarray:
        """Whether each text holds each key of an ascending vocabulary."""
        out = np.zeros((self.n_docs, len(vocabulary)), dtype=bool)
        if len(vocabulary) and len(self.keys):
            at = np.minimum(np.searchsorted(vocabulary, self.keys), len(vocabulary) - 1)
            hit = vocabulary[at] == self.keys
            has = np.flatnonzero(hit.any(axis=1)[self.word])
            for i in range(self.keys.shape[1]):
                mine = has[hit[self.word[has], i]]
                out[self.doc[mine], at[self.word[mine], i]] = True
        return out


def _patterns(column: pa.Array) -> np.ndarray:
    """Pattern votes per text: mostly capitals; an exclamation mark in every 50 bytes."""
    data, offsets = raw_text(column)
    size = np.maximum(np.diff(offsets), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(kind)]
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    return np.stack([share((data >= 65) & (data <= 90)) > 0.3, share(data == 33) > 0.02], axis=1)


def learn_lexicon(labelled: DataFrame) -> np.ndarray:
    """Keys of the entries that go with toxic texts, best first, from rows (text, toxic)."""

    def count(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            text = batch.column("text")
            for a, b in slices(text, 4 * SLICE_BYTES):
                doc, key = Entries(text.slice(a, b - a)).pairs()
                entry, at = np.unique(key, return_inverse=True)
                bad = np.bincount(at, toxic[a:b][doc], minlength=len(entry))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entry.view(np.int64)), pa.array(bad.astype(np.int64)),
                     pa.array(np.bincount(at, minlength=len(entry)).astype(np.int64))], names=["entry", "bad", "seen"])

    counted = labelled.select("text", "toxic").mapInArrow(count, "entry long, bad long, seen long").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    best = counted.filter((F.col("seen") >= LEAST_SEEN) & (F.col("bad") >= F.col("seen") * LEAST_SHARE)).orderBy(
        F.desc(F.col("bad") - 3 * (F.col("seen") - F.col("bad"))), "entry").limit(ENTRIES)
    return best.toPandas()["entry"].to_numpy(dtype=np.int64).view(np.uint64)


def votes(has: np.ndarray, column: pa.Array) -> np.ndarray:
    """Votes of all voters on each text, from the entries that it has (best entry first): entries
    are dealt to the lexicons in turn."""
    lexicons = np.stack([has[:, i::LEXICONS].any(axis=1) for i in range(LEXICONS)], axis=1)
    return np.concatenate([lexicons, _patterns(column)], axis=1)


def _presence(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    ascending = np.sort(lexicon)
    return Entries(column).presence(ascending)[:, np.searchsorted(ascending, lexicon)]


def vote_table(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """How many documents have each pattern of votes, a bit per voter: at most 2 ** voters rows."""
    bits = 1 << np.arange(N_VOTERS)

    def count(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, 4 * SLICE_BYTES):
                part = text.slice(a, b - a)
                pattern, n = np.unique(votes(_presence(part, lexicon), part) @ bits, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["votes", "n"])

    return docs.select("text").mapInArrow(count, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))


class LabelModel:
    """Two classes, voters that are independent given the class but for groups that correlate.

    Expectation maximisation over the vote patterns gives each voter's rates in both classes.
    Voters whose votes still correlate within classes share one voice: what each adds to the
    log odds is divided by the correlations it has.
    """

    def __init__(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> None:
        x, n = patterns.astype(float), n.astype(float)
        self.voice = np.ones(x.shape[1])
        lexicon_hits = x[:, :LEXICONS].sum(axis=1)
        q = np.where(lexicon_hits > 0, 0.9, 0.02)
        for step in range(rounds):
            self._rates(x, n, q)
            if step == rounds // 2:
                self._correlate(x, n, q)
            q = self.posterior(patterns)

    def _rates(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        toxic, clean = n * q, n * (1 - q)
        self.prior = float(np.clip(toxic.sum() / max(n.sum(), 1), 1e-4, 0.5))
        # a voter says toxic more often of toxic texts; the added counts hold rare voters back
        self.clean = (clean @ x + 0.1) / (clean.sum() + 10)
        self.toxic = np.maximum((toxic @ x + 0.5) / (toxic.sum() + 5), self.clean)

    def _correlate(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        excess = np.zeros((x.shape[1],) * 2)
        for weight, rate in ((n * q, self.toxic), (n * (1 - q), self.clean)):
            if weight.sum() > 1:
                d = (x - rate) * np.sqrt(weight / weight.sum())[:, None]
                spread = np.sqrt(np.maximum((d * d).sum(axis=0), 1e-9))
                excess = np.maximum(excess, np.clip(d.T @ d / np.outer(spread, spread) - 0.2, 0, 1))
        np.fill_diagonal(excess, 1)
        self.correlations = excess
        self.voice = 1 / excess.sum(axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        said = np.log(self.toxic / self.clean)
        silent = np.log((1 - self.toxic) / (1 - self.clean))
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + patterns @ (said * self.voice)
                        + (1 - patterns) @ (silent * self.voice))


def _inputs(has: np.ndarray, column: pa.Array) -> np.ndarray:
    return np.concatenate([has, _patterns(column), np.ones((len(has), 1))], axis=1).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from all ``docs`` (doc_id, text) and the ``labels`` (doc_id, toxic) of some.

    Lexicons come from at most about ``LABELLED`` labelled rows; the votes of all documents make
    the label model; the classifier is fitted on its posteriors of at most about ``SAMPLE``
    documents. None if no entry goes with toxic texts.
    """
    lexicon = learn_lexicon(sampled(docs, labels.filter("toxic is not null").select("doc_id", "toxic"), LABELLED))
    if not len(lexicon):
        return None
    bits = 1 << np.arange(N_VOTERS)
    counted = vote_table(docs, lexicon).toPandas()
    patterns = (counted["votes"].to_numpy()[:, None] & bits > 0).astype(float)
    label_model = LabelModel(patterns, counted["n"].to_numpy())

    def sample(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, 4 * SLICE_BYTES):
                part = text.slice(a, b - a)
                has = _presence(part, lexicon)
                x = _inputs(has, part)
                q = label_model.posterior(votes(has, part).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), pa.array(q)], names=["x", "q"])

    seen = bounded(docs.select("doc_id", "text"), SAMPLE).select("text").mapInArrow(
        sample, "x binary, q double").groupBy("x").agg(F.sum("q").alias("q"), F.count("*").alias("n")).toPandas()
    x = np.stack([np.frombuffer(r, np.float32) for r in seen["x"]])
    toxic = seen["q"].to_numpy(dtype=np.float32)
    clean = seen["n"].to_numpy(dtype=np.float32) - toxic
    # both classes weigh alike, so that rare toxic texts shape the weights
    toxic, clean = toxic / (toxic.sum() + 1), clean / (clean.sum() + 1)
    w = _descend(x, lambda z: clean * _sigmoid(z) - toxic * (1 - _sigmoid(z)), 800)
    return {"w": w, "label_model": label_model, "lexicon": lexicon}


def scores(column: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    return _sigmoid(_inputs(_presence(column, model["lexicon"]), column) @ model["w"]).astype(np.float64)


def score(docs: DataFrame, model: dict | None, cut: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``cut`` on) of every whole text.

    Null texts count as empty; an empty one gets the score of a text without any lexicon
    entry. With nothing learned every score is 0. Rows that repeat give repeated rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, 4 * SLICE_BYTES):
                s = scores(text.slice(a, b - a), box.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, score double, predicted int")
