"""N-gram join, mixing, BPE and language model beside brute force, and on odd rows."""

import collections
import hashlib
import json
import math
import re
import unicodedata
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.conftest import SF, documents
from tests.oracle_check import compare, duck
from tokenizers import Tokenizer

from talkmine.llm import bpe, brown_lm, mixing, ngram_join
from talkmine.llm.partenum import Scheme, signatures
from talkmine.llm.queries import ORACLES, QUERIES, TOKENIZER
from talkmine.llm.text import Words, mix, shingle_sets, slices

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=60, deadline=None)
@examples(st.lists(st.one_of(st.none(), st.text(alphabet="aAé \t\n\x1f漢", max_size=30)), max_size=8))
def test_words_and_shingles(texts):
    column = pa.array(texts, pa.string())
    found = Words(column, spans=True)
    shown = [bytes(found.data[s:e]).decode().translate(LOWER) for s, e in zip(found.start, found.end)]
    assert shown == [w for t in texts for w in words_of(t)]
    assert len(set(zip(shown, found.hash.tolist()))) == len(set(shown)) == len(set(found.hash.tolist()))
    assert [len(s) for s in shingle_sets(found, 5)] == [len(shingles(t)) for t in texts]
    assert [b for _, b in slices(column, 20)][-1:] == ([len(texts)] if texts else [])


def test_a_text_longer_than_a_piece_is_cut_between_words():
    text = "ab " * 3_000_000 + "c" * 5_000_000 + " d"
    found = Words(pa.array([text]))
    assert len(found.hash) == 3_000_002 and len(set(found.hash.tolist())) == 3


@pytest.mark.parametrize("scheme", [Scheme(parts=2, damage=1, spare=0.3), Scheme(parts=4, damage=2), Scheme(parts=1, damage=0)])
def test_similar_sets_share_a_signature(scheme):
    rng = np.random.default_rng(3)
    for n in [4, 5, 6, 9, 10, 17, 40, 111, 500]:
        for _ in range(30):
            a = np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
            gone = rng.integers(0, n // 5 + 1)
            b = rng.permutation(a)[gone:]
            new = mix(rng.integers(0, 1 << 62, rng.integers(0, n // 5 + 1)).astype(np.uint64))
            b = np.unique(np.r_[b, new])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
                assert np.intersect1d(signatures(a, scheme), signatures(b, scheme)).size


def components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            low[g] = min(low.get(g, doc), doc)
    return sorted(((d, len(s), low.get(g, d)) for (d, _), s, g in zip(rows, sets, group)), key=str)


def chains(n=40):
    """A chain of near copies, groups that share only a passage, and many copies of one text."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        out.append((100 + i, " ".join(base[:60 - i % 30] + [f"x{i % 30}_{j}" for j in range(i % 30)])))
        out.append((300 + i, " ".join(base[:40] + [f"y{i}_{j}" for j in range(20)])))
        out.append((500 + i, "the very same text that everybody copies word by word"))
        out.append((700 + i, " ".join(base + [f"z{i}"])))
    return out


def test_groups_agree_with_all_pairs(spark, given):
    rows = [(r.doc_id, r.text) for r in given.collect()] + [(10_000 + a, b) for a, b in chains()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rows = chains()
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == components(rows)


def test_candidate_pairs_go_in_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ngram_join, "_rounds", lambda *given: asked.append(given) or 2)
    rows = chains()
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == components(rows)
    assert len(asked) == 2


def test_sets_after_the_pivots_are_named():
    def batch(ids):
        return pa.RecordBatch.from_arrays([
            pa.array([0], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[1] * len(ids)], pa.list_(pa.int16())),
            pa.array([[7] * len(ids)], pa.list_(pa.int32()))], names=["place", "ids", "counts", "sigs"])

    for slices in ([[1, 2, 3, 4, 5, 6]], [[1, 2], [3, 2], [4, 5, 6]], [[1], [2, 3, 4, 5, 6]]):
        rows = [r for out in ngram_join._meet(iter(map(batch, slices)), most=3, buffer=1) for r in out.to_pylist()]
        named = {r["member"] for r in rows if r["sig"] is not None}
        found = {frozenset((r["pivot"], r["member"])) for r in rows} | {frozenset(p) for p in combinations(named, 2)}
        assert found == {frozenset(p) for p in combinations(range(1, 7), 2)}
        assert {3, 4, 5, 6} >= named >= {5, 6}
        few = [r for out in ngram_join._meet(iter(map(batch, slices)), most=8, buffer=1) for r in out.to_pylist()]
        assert all(r["sig"] is None for r in few)


def test_blocks_carry_half_sketches(spark):
    groups = spark.range(600).select(F.lit(5).cast("long").alias("sig"), F.lit(-1).cast("long").alias("pivot"), F.col("id").alias("member"))
    labels = spark.createDataFrame([], "node long, component long")
    sketch = F.when(F.col("id") == 0, F.array(F.lit(9).cast("long"))).otherwise(F.array(*[F.lit(x).cast("long") for x in (1, 2, 4, 8)]))
    rows = ngram_join._blocks(groups, labels, spark.range(600).select(
        F.col("id").alias("set_id"), F.lit(100).cast("long").alias("n"), sketch.alias("sketch")))[0].collect()
    assert len(rows) == 1 and rows[0].right is None
    assert {r.member: r.sketch for r in rows[0].left} == {0: [9]} | {i: [5, 10] for i in range(1, 600)}


def test_signature_tasks_follow_the_features(spark, given):
    scheme = ngram_join.Scheme(percent=80, parts=2, damage=1, spare=0.3)
    tasks = ngram_join.signature_groups(given, 400_000_000, scheme).rdd.getNumPartitions()
    assert tasks == max(100, spark.sparkContext.defaultParallelism)


def test_groups_of_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = ngram_join.similar_groups(odd_documents).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)
    assert ngram_join.similar_groups(no_documents).count() == 0


def test_one_of_each_group_stays(odd_documents, no_documents):
    kept = ngram_join.one_of_each_group(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, None, 5, 6, 7, 9, 10], key=str)
    assert ngram_join.one_of_each_group(no_documents).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(3000)]
    got = mixing.mix(documents(spark, rows)).join(documents(spark, rows).select("doc_id", "source"), "doc_id").collect()
    total, taken, target = sum(r.size for r in got), collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)


def test_mix_of_odd_rows(odd_documents, no_documents):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert sum(r.target for r in {r.source_size: r for r in got}.values()) > 0
    again = mixing.mix(odd_documents).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    drawn = mixing.mixed_documents(odd_documents)
    assert drawn.columns == odd_documents.columns and drawn.count() == sum(r.copies for r in got)
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0


LIBRARY = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@examples(st.text(max_size=60))
def test_bpe_agrees_with_the_library(text):
    own, ids = bpe.load(TOKENIZER), LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_knows_every_character():
    """All code points but every seventh of those in the large blocks without case or marks."""
    large = [(0x3400, 0xD7A3), (0xE000, 0xF8FF), (0x17000, 0x18CFE), (0x1F000, 0xDFFFF), (0xF0000, 0x10FFFF)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (
        c % (701 if c > 0x33500 else 7) == 0 or not any(a <= c <= b for a, b in large))]
    own = bpe.load(TOKENIZER)
    texts = [f":{chr(c)}a" for c in points]
    found = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, t, e in zip(points, texts, found) if own.encode(t) != e.ids] == []
    marks = [chr(c) for c in points if unicodedata.combining(chr(c))] + [chr(c) for c in range(0x11930, 0x11940)]
    texts = ["".join(t) for t in zip("aeq" * len(marks), marks, reversed(marks), marks[7:], "\u0301\u0345" * len(marks))]
    found = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, found) if own.encode(t) != e.ids] == []


@pytest.mark.parametrize("text", [
    "<|endoftext|>hi <|startoftext|> x<|endoftext", "Don't we'LL 'S 123 ½ ΑΣ ΣΑΣ İ \x1c\x85é 가 ﬀ ßẞ\x00", "a" * 30_000,
    "!!!###'t't", " ", " 　x﻿"])
def test_bpe_of_odd_texts(text):
    assert bpe.load(TOKENIZER).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [2, 15, 16, 17, 18, 255, 256, 257, 258, 4097])
def test_bpe_of_pieces_at_the_borders_of_nodes(n):
    for text in ("a" * n, ("anotherinthe" * n)[:n], "".join(chr(97 + i * i % 26) for i in range(n)), "\u6f22" * n):
        assert bpe.load(TOKENIZER).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_takes_words_of_letters_as_they_are():
    with open(TOKENIZER, encoding="utf-8") as file:
        own = bpe.Bpe(json.load(file))
    own.piece = None  # the pattern of all letters
    text = "Hello, world's \u00dcnited e\u0301t\u00e9 \u03a3\u0391\u03a3 \u6f22\u5b57 12!"
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_workers_forget_words_after_a_task(spark, given):
    def held(batches):
        for batch in batches:
            own = bpe.load(TOKENIZER)
            yield pa.RecordBatch.from_arrays([pa.array([len(own.words) + len(own.pieces)] * batch.num_rows, pa.int64())],
                                             names=["n"])

    assert len(bpe.encoded(given.repartition(8), TOKENIZER).collect()) == given.count()
    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_bpe_of_whole_table(odd_documents, no_documents):
    for r in bpe.encoded(odd_documents, TOKENIZER).join(odd_documents.select("doc_id", "text"), "doc_id").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        shown = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert bpe.encoded(no_documents, TOKENIZER).count() == 0


def counted(rows):
    tokens = [(d, words_of(t) + [None]) for d, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    count = collections.Counter(w for (_, ts), h in zip(tokens, held) if not h for w in ts)
    total = sum(count.values())
    return sorted(((d, h, len(ts), sum(count[w] > 0 for w in ts), total, round(sum(
        math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ts), 5)) for (d, ts), h in zip(tokens, held)), key=str)


def test_lm_counts_agree_with_brute_force(spark, given, odd_documents, monkeypatch):
    both = given.select("doc_id", "text").union(odd_documents.select("doc_id", "text"))
    rows = [tuple(r) for r in both.collect()]
    monkeypatch.setattr(brown_lm, "FREQUENT", 300)
    got = brown_lm.score(both, model=brown_lm.train(both.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2")))
    rows_found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                         for r in got.collect()), key=str)
    want = sorted(counted(rows), key=str)
    assert sorted((r[:5] for r in rows_found), key=str) == sorted((r[:5] for r in want), key=str)
    assert sorted(r[5] for r in rows_found) == pytest.approx(sorted(r[5] for r in want), abs=1e-4)


def test_lm_classes_beat_the_base(spark):
    got = brown_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_without_texts(no_documents, spark):
    assert brown_lm.score(no_documents).count() == 0
    only_held = documents(spark, [(i, "a b", "en", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert {(r.n_known, r.train_tokens, r.base_score) for r in brown_lm.score(only_held).collect()} == {(0, 0, 0.0)}


def test_exchange_finds_words_that_behave_alike():
    rng = np.random.default_rng(0)
    kind = np.arange(20) % 2  # words of one kind follow words of the other
    table = np.zeros((21, 21))
    for _ in range(20_000):
        u, v = rng.integers(0, 20, 2)
        if kind[u] != kind[v]:
            table[u, v] += 1
    own = brown_lm.exchange(table, 20, classes=2)
    assert len({(k, c) for k, c in zip(kind, own[:20])}) == 2


def test_blocks_count_differing_cells_of_the_top_bit():
    members = pa.array([
        {"member": i, "component": i, "n": 10, "sketch": [word]} for i, word in ((1, 0), (2, -(1 << 63) | 1))],
        pa.struct([("member", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))]))
    block = ngram_join._Block(members)
    assert ngram_join._close(block, block, 80).tolist().count([0, 1]) == 1


def test_words_go_to_the_class_that_gains_most():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 9, (400, 2))  # class words 0 to 3, an end, two lengths: 5 and 6 of one, 7 and 8 of the other
    bigrams = np.zeros((9, 9))
    np.add.at(bigrams, (units[:, 0], units[:, 1]), rng.integers(1, 9, 400))

    def likelihood(own):
        table = np.zeros((7, 7))
        np.add.at(table, (own[:, None], own[None, :]), bigrams)
        return sum(brown_lm._gain(x).sum() for x in (table,)) - sum(brown_lm._gain(table.sum(axis=i)).sum() for i in (0, 1)), table

    own = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6])
    words = np.array([5, 6, 7, 8])
    table = likelihood(own)[1]
    before, after = (np.stack([np.bincount(own, x, minlength=7) for x in side]) for side in (bigrams[:, words].T, bigrams[words]))
    got = brown_lm.assign(table, 4, own[words], before, after, bigrams[words, words])
    want = [int(np.argmax([likelihood(np.where(np.arange(9) == w, c, own))[0] for c in range(4)])) for w in words]
    assert got.tolist() == want


def test_lm_puts_every_word_seen_twice_into_a_class(spark, given, odd_documents, monkeypatch):
    docs = given.select("doc_id", "text").limit(150).union(odd_documents.select("doc_id", "text"))
    trains = docs.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2")
    monkeypatch.setattr(brown_lm, "CLASS_WORDS", 50)
    whole = brown_lm.train(trains)
    assert ((whole["class"] < whole["classes"]) == ((whole["counts"] > 1) & (whole["words"] != brown_lm.END))).all()
    # transitions of all words make probabilities of every class after each
    assert whole["known_table"].sum() == whole["n"] and (whole["known_table"] == whole["table"]).all()
    monkeypatch.setattr(brown_lm, "FREQUENT", 200)
    model = brown_lm.train(trains)
    assert model["n_rare"] > 0
    seen = {}
    real = brown_lm._with_probabilities
    monkeypatch.setattr(brown_lm, "_with_probabilities", lambda m, table: seen.setdefault("model", real(m, table)))
    got = brown_lm.score(docs, model=model).collect()
    table, m = seen["model"], seen["model"]
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    count = collections.Counter(w for (_, ws), h in zip(rows, held) if not h for w in ws)
    hashes = {w: int(brown_lm._tokens(pa.array([w]))[1][0]) for _, ws in rows for w in ws}
    frequent = dict(zip(m["words"].tolist(), m["class"].tolist()))
    start = {w: frequent.get(h, m["end"] + min(len(w.encode()), 12)) for w, h in hashes.items()}
    # each rare word seen twice or more, judged by all its neighbours
    k = m["k"]
    beside = collections.defaultdict(lambda: np.zeros((2, k)))
    itself = collections.Counter()
    for (_, ws), h in zip(rows, held):
        for a, b in zip([None, *ws], [*ws, None]):
            if not h and b is not None:
                beside[b][0, m["end"] if a is None else start[a]] += 1
            if not h and a is not None:
                beside[a][1, m["end"] if b is None else start[b]] += 1
            itself[a] += not h and a is not None and a == b
    own = {}
    for w in start:
        own[w] = start[w]
        if hashes[w] not in frequent and count[w] > 1:
            own[w] = int(brown_lm.assign(m["table"], m["classes"], np.array([start[w]]), beside[w][:1], beside[w][1:],
                                         np.array([itself[w]]))[0])
    steps = np.zeros((k, k))
    for (_, ws), h in zip(rows, held):
        line = [m["end"], *[own[w] for w in ws], m["end"]]
        if not h:
            np.add.at(steps, (line[:-1], line[1:]), 1)
    want = real(m, steps)
    assert np.allclose(want["follows"], table["follows"])
    scores = []
    for d, ws in rows:
        line = [m["end"], *[own[w] for w in ws], m["end"]]
        scores.append(sum(want["follows"][a * k + b] + want["emits"][b] for a, b in zip(line, line[1:]))
                      + sum(math.log10(count[w] + (own[w] >= m["classes"])) for w in ws))
    assert sorted(r.score for r in got) == pytest.approx(sorted(scores), abs=1e-6)
    assert all(own[w] < m["classes"] for w in own if count[w] > 1)
