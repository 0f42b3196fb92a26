"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model on the shape of a text: how its
characters follow one another by kind, whatever its language. The loss is the non-negative
unbiased risk, with a class prior estimated from how a first positive-against-unlabelled
model ranks both sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmine.llm.text import raw_text, slices, tidy

#: cells of hashed shape trigrams
CELLS = 512
#: rows of each kind that the model is fitted on
SAMPLE = 8000

_KIND = np.zeros(256, dtype=np.int64)  # 0: bytes of letters beyond ASCII
_KIND[:32] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("A"):ord("Z") + 1] = 3
_KIND[ord("0"):ord("9") + 1] = 4
for _i, _c in enumerate(b" \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 5 + _i
_KINDS = int(_KIND.max()) + 1
_CELL_OF = ((np.arange(_KINDS ** 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(
    np.int64) % CELLS
N_FEATURES = _KINDS + CELLS + 3


def features(column: pa.Array) -> np.ndarray:
    """Per text the root shares of kinds and shape trigrams of its bytes, and three of its words:
    root share of distinct ones, log mean length, log number. Without text all are 0."""
    data, offsets = raw_text(column)
    n = len(offsets) - 1
    kind = _KIND[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out[:, :_KINDS] = np.sqrt(np.bincount(doc * _KINDS + kind, minlength=n * _KINDS).reshape(n, -1) / size)
    if len(data) > 2:
        cell = _CELL_OF[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
        whole = doc[:-2] == doc[2:]
        out[:, _KINDS:_KINDS + CELLS] = np.sqrt(np.bincount(
            doc[:-2][whole] * CELLS + cell[whole], minlength=n * CELLS).reshape(n, -1) / size)
    for i, text in enumerate(column.fill_null("").to_pylist()):
        words = text.split()
        if words:
            out[i, -3:] = (np.sqrt(len(set(words)) / len(words)), np.log1p(len(text) / len(words)),
                           np.log1p(len(words)) / 10)
    return out


def feature_table(rows: DataFrame) -> DataFrame:
    """Features of each text as bytes of float32."""

    def compute(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in features(text.slice(a, b - a))], pa.binary())], names=["features"])

    return rows.select("text").mapInArrow(tidy(compute), "features binary")


def bounded(rows: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """About ``most`` rows at random by a hash of ``by``, all if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(1 << 30)) < share)


def _descend(x: np.ndarray, gradient, rounds: int) -> np.ndarray:
    """Adam on the weights of a linear model; ``gradient`` maps scores to what each row adds."""
    w = np.zeros(x.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x.T @ gradient(x @ w).astype(np.float32) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Largest share of positives that the scores of both sets allow: the least ratio of their
    shares above any cut, each cut with an allowance for its sampling error."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.95, 37))
    above_p = (positive[None, :] > cuts[:, None]).mean(axis=1)
    above_u = (unlabelled[None, :] > cuts[:, None]).mean(axis=1)
    slack = 1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))
    usable = above_p > 0.2
    ratio = (above_u[usable] + slack * above_p[usable]) / above_p[usable]
    return float(np.clip(ratio.min(), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> dict:
    """Weights, scale and prior of the model; rows are features."""
    n_p, n_u = len(positive), len(unlabelled)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    x = np.concatenate([(both - mean) / scale, np.ones((len(both), 1))], axis=1).astype(np.float32)
    is_p = np.arange(len(x)) < n_p

    def against_unlabelled(z):
        s = _sigmoid(z)
        return np.where(is_p, (s - 1) / n_p, s / n_u) / 2

    rank = x @ _descend(x, against_unlabelled, 60)
    prior = class_prior(rank[:n_p], rank[n_p:])

    def non_negative(z):
        s = _sigmoid(z)
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        if negative_risk < 0:  # climb back: only the part that went below zero moves
            return np.where(is_p, prior * s / n_p, -s / n_u)
        return np.where(is_p, prior * ((s - 1) - s) / n_p, s / n_u)

    w = _descend(x, non_negative, rounds)
    return {"w": w[:-1], "b": float(w[-1]), "mean": mean, "scale": scale, "prior": prior}


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts of about ``most`` labelled documents at most; ``labels`` are drawn by a hash of the id.

    The draw is what bounds the broadcast, so no text is shuffled. A document that is labelled
    more than once keeps its least label.
    """
    rest = [c for c in labels.columns if c != "doc_id"]
    drawn = bounded(labels, most).groupBy("doc_id").agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in rest])
    return docs.select("doc_id", "text").join(F.broadcast(drawn.drop("__n")), "doc_id")


def train(docs: DataFrame, trusted: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model from the ``trusted`` positives (doc_id) and unlabelled ``docs`` (doc_id, text), fitted on
    at most about ``sample`` rows of each, drawn by a hash of the id. None without a row of either."""
    seen = [feature_table(rows.select("text")).toPandas()["features"] for rows in (
        sampled(docs, trusted.select("doc_id"), sample), bounded(docs.select("doc_id", "text"), sample))]
    if not all(len(s) for s in seen):
        return None
    return fit(*[np.stack([np.frombuffer(f, np.float32) for f in s]) for s in seen])


def scores(column: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(column), 0.5)
    return _sigmoid((features(column) - model["mean"]) / model["scale"] @ model["w"] + model["b"]).astype(np.float64)


def classify(docs: DataFrame, model: dict | None, cut: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 from ``cut`` on) of every whole text.

    Null texts count as empty and empty ones get the score of no features. With nothing learned
    every score is 0.5. Rows that repeat give repeated rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                s = scores(text.slice(a, b - a), box.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(compute), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | None, cut: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``cut``, unchanged."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def compute(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                yield batch.slice(a, b - a).select(columns).filter(pa.array(scores(text.slice(a, b - a), box.value) >= cut))

    return docs.mapInArrow(tidy(compute), docs.schema)
