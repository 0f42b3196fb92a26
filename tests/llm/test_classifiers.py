"""Language, toxicity and quality: held-out accuracy, methods on small cases, odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmine.llm import langid, quality, toxicity
from talkmine.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def accuracy(spark, name, column):
    got = QUERIES[name](spark, SF)
    truth = spark.read.parquet(f"{SF}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", column)
    guess = "lang_pred" if column == "lang" else "predicted"
    rows = got.join(truth, "doc_id").filter("held_out").select(guess, column, "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r[0] == r[1] for r in rows])


@pytest.mark.parametrize("name, column, least", [
    ("op5_language", "lang", 0.98), ("op6_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, column, least):
    assert accuracy(spark, name, column) >= least


def test_viterbi_agrees_with_all_paths():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 4]
    first = np.r_[0, np.cumsum(sizes)]
    scores = rng.normal(size=(sum(sizes), 3)) * 4
    path = langid.viterbi(scores, first, penalty=2.5)
    for a, b in zip(first, first[1:]):
        def worth(p):
            return sum(scores[a + i, s] for i, s in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max((worth(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert worth(path[a:b].tolist()) == pytest.approx(best)


def test_spans_of_mixed_text_and_scripts(spark):
    english, russian = "the quick brown fox jumps over the lazy dog ", "съешь ещё этих мягких французских булок "
    french = "portez ce vieux whisky au juge blond qui fume "
    rows = [(i, t * 5, lang) for i, (t, lang) in enumerate([(english, "en"), (russian, "ru"), (french, "fr")] * 4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["en", "fr", "ru"]
    mixed = spark.createDataFrame([(1, english * 3 + french * 3 + russian)], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"]


def test_language_of_odd_rows(odd_documents, no_documents):
    model = langid.learn_from(odd_documents)
    got = langid.identify(odd_documents, model).collect()
    assert len(got) == odd_documents.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    kept = langid.keep_known(odd_documents, model)
    assert kept.columns == odd_documents.columns and {2, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = langid.learn_from(no_documents)
    assert langid.identify(no_documents, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_documents, nothing).collect()} == {"und"}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    marks = labels(spark, [(i, 1, i % 2) for i in range(1, 12)] + [(1, 0, 1), (None, None, None), (99, 1, 1)])
    model = toxicity.train(odd_documents, marks)
    got = toxicity.score(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(odd_documents, marks.limit(0)) is None
    assert toxicity.train(no_documents, marks) is None
    assert toxicity.score(no_documents, None).count() == 0


def test_label_model_weighs_voters():
    rng = np.random.default_rng(2)
    y = rng.random(5000) < 0.2
    votes = np.zeros((5000, toxicity.N_VOTERS), bool)
    good = [0.9, 0.8, 0.7, 0.6, 0.9, 0.8, 0.7, 0.6, 0.5, 0.5, 0.5, 0.5]
    for i, rate in enumerate(good):
        votes[:, i] = np.where(y, rng.random(5000) < rate, rng.random(5000) < 0.02)
    votes[:, 5] = votes[:, 4]  # says the same as another
    votes[:, -2:] = (rng.random(5000) < 0.1)[:, None]
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns.astype(float), n)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert model.toxic[0] == pytest.approx(0.9, abs=0.05) and model.clean[0] == pytest.approx(0.02, abs=0.02)
    assert model.voice[4] < 0.7 and model.voice[0] > 0.7
    assert np.mean((model.posterior(votes.astype(float)) > 0.5) == y) > 0.97


def test_entries_hold_words_and_beginnings():
    entries = toxicity.Entries(pa.array(["Lowlife person", "lowland", None, "x"]))
    doc, key = entries.pairs()
    shared = set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())
    assert len(shared) == 1 and not (doc == 2).any()  # "lowl" of both
    has = entries.presence(np.sort(np.array(list(shared), dtype=np.uint64)))
    assert has[:, 0].tolist() == [True, True, False, False]


def test_positive_unlabelled_finds_the_negatives():
    rng = np.random.default_rng(4)
    positive = rng.normal(1, 1, (1500, 5))
    truth = rng.random(3000) < 0.7
    unlabelled = np.where(truth[:, None], rng.normal(1, 1, (3000, 5)), rng.normal(-1.5, 1, (3000, 5)))
    model = quality.fit(positive.astype(np.float32), unlabelled.astype(np.float32))
    assert model["prior"] == pytest.approx(0.7, abs=0.12)
    z = (unlabelled - model["mean"]) / model["scale"] @ model["w"] + model["b"]
    assert np.mean((z > 0) == truth) > 0.95


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    marks = labels(spark, [(i, 1, 0) for i in (1, 6, 7, 8)] + [(1, 1, 0), (None, 1, 0)])
    model = quality.train(odd_documents, marks)
    got = quality.classify(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.train(no_documents, marks) is None and quality.train(odd_documents, marks.limit(0)) is None
    assert {r.score for r in quality.classify(odd_documents, None).collect()} == {0.5}


def test_bounded_sample_is_a_hash_of_ids(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "doc_id")
    n = quality.bounded(rows, 5000).count()
    assert 4500 < n < 5500 and quality.bounded(rows.filter(F.col("doc_id") < 10), 5000).count() == 10
