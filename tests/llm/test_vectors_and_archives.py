"""Near-duplicate vectors, exact top k, WARC files and the pipeline."""

import collections
import gzip
import hashlib
import io
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF
from tests.llm.test_text_operators import LIBRARY, components, words_of

import corpus_pipeline
from talkmine.llm import langid, quality, topk, vector_dedup, warc
from talkmine.llm.bitmap import bitmap, hits
from talkmine.session import fresh_dir

VECTOR = "vec_id long, embedding array<double>, label int"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.01], 1), (20, [1.0, 0.01], 1), (40, [1.0, 0.0], 2), (3, [1.0, 0.0], None),
            (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1),
            (None, [1.0, 0.0], 1), (9, [1e-300, 0.0], 1), (10, [1.0], 1), (11, [], 1), (12, [-0.0, -1.0], 1)]
    return spark.createDataFrame(rows, VECTOR).withColumn("score", F.lit("extra"))


def planted(spark, n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = rng.normal(size=32)
        x /= np.linalg.norm(x)
        y = rng.normal(size=32)
        y -= y @ x * x
        y /= np.linalg.norm(y)
        c = 0.935 + 0.06 * rng.random()
        rows += [(2 * i, x.tolist(), i % 3), (2 * i + 1, (3 * (c * x + np.sqrt(1 - c * c) * y)).tolist(), i % 3)]
    rows += [(10_000 + i, rows[0][1], 0) for i in range(300)]  # many copies of one
    return spark.createDataFrame(rows, VECTOR)


def test_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 50)
    df = planted(spark)
    rows = df.collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = dict(zip((r.vec_id for r in rows), link.sum(axis=1)))
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert all(got[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(want.values())
    assert got[10_005].component_id == 0 and not got[10_005].kept and got[0].kept


@pytest.mark.parametrize("n", [1000, 8000])
def test_recall_at_two_sizes(spark, n):
    """Pairs of cosine 0.93 to 0.99 among vectors of one label: the index grows with them."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(400, 64))
    y -= (y * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    c = 0.932 + 0.05 * rng.random((400, 1))
    y = c * x[:400] + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.r_[x, y])]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTOR)).collect()}
    assert sum(got[n + i] for i in range(400)) >= 0.95 * 400 and sum(got.values()) <= 2 * 400


def test_blocks_without_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ASSIGNED", 2)
    rows = [(i, [1.0, 0.01 * i], 0) for i in range(12)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTOR)).collect()
    assert {r.component_id for r in got} == {0} and all(6 <= r.n_links <= 11 for r in got)


def test_a_tiny_vector_spoils_no_pivot(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)] + [(300, [1e-300] * 8, 0)]
    nodes = spark.createDataFrame(rows, VECTOR).select(
        F.struct("label").alias("group"), F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), F.lit(301).alias("n"))
    ordered = vector_dedup.permutations(nodes, vector_dedup.choose_pivots(nodes))
    pivots = ordered.select(F.explode("pivots")).distinct().count()
    assert ordered.count() == 301 and pivots >= 20


def test_odd_vectors(spark):
    got = vector_dedup.near_duplicates(odd_vectors(spark)).collect()
    assert len(got) == 15
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    # 0, both rows of 20, the row without an id and 9 (the same direction) are one group
    assert by[0] == (4, 0) and by[20] == (4, 0) and by[9] == (4, 0) and by[None] == (4, 0)
    assert all(by[i] == (0, i) for i in (40, 3, 4, 5, 6, 7, 8, 10, 11, 12))
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTOR)).count() == 0


def brute_top(rows, k):
    usable = [(i, r.vec_id, np.floor(64 * np.array(r.embedding))) for i, r in enumerate(rows)
              if r.vec_id is not None and r.embedding is not None and None not in r.embedding
              and np.isfinite(r.embedding).all()]
    width = max(len(v) for *_, v in usable)
    pad = [(i, d, np.pad(v, (0, width - len(v)))) for i, d, v in usable]
    out = []
    for i, q, v in pad:
        if q % 20 == 0:
            best = sorted((-int(v @ w), d) for j, d, w in pad if j != i)[:k]
            out += [(q, n, d, -s) for n, (s, d) in enumerate(best, 1)]
    return sorted(out)


def test_blocks_are_numbered_without_moving_matrices(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.col("id").alias("vec_id"), F.array("id").alias("vector"))
    blocks = topk._packed(rows, 1000, 100, 1)
    assert sum(n > 0 for n in blocks.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) > 1
    got = blocks.orderBy("block").collect()
    assert [r.block for r in got] == list(range(len(got))) and sorted(i for r in got for i in r.rows) == list(range(1000))
    assert all(np.frombuffer(r.matrix, np.int64).tolist() == r.rows for r in got)


@pytest.mark.parametrize("k, lists", [(1, 1), (5, 3), (20, 4), (2000, 4)])
def test_top_scores_agree_with_brute_force(spark, monkeypatch, k, lists):
    monkeypatch.setattr(topk, "ROWS", 97)
    monkeypatch.setattr(topk, "QUERIES", 11)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(400)
    got = sorted(tuple(r) for r in topk.top_scores(df, k=k, lists=lists).collect())
    assert got == brute_top(df.collect(), k)


def test_top_scores_of_odd_rows_and_large_numbers(spark):
    df = odd_vectors(spark)
    assert sorted(tuple(r) for r in topk.top_scores(df, k=3).collect()) == brute_top(df.collect(), 3)
    # 64 times 59 << 19, squared, still fits a long; 59 << 20 doesn't
    big = spark.createDataFrame([(i, [float(i << 19), 3.0 * i + 1], 0) for i in range(60)], VECTOR)
    assert sorted(tuple(r) for r in topk.top_scores(big, k=4).collect()) == brute_top(big.collect(), 4)
    for rows in ([(i, [float(i << 20), 3.0 * i + 1], 0) for i in range(60)], [(0, [1e300], 0), (1, [1.0], 0)]):
        with pytest.raises(OverflowError):
            topk.top_scores(spark.createDataFrame(rows, VECTOR), k=4)
    assert topk.top_scores(spark.createDataFrame([], VECTOR)).count() == 0
    assert topk.top_scores(spark.createDataFrame([(1, [1.0], 0)], VECTOR)).count() == 0
    assert topk.top_scores(spark.createDataFrame([(20, [1.0], 0)], VECTOR)).count() == 0


@pytest.mark.parametrize("payload", [b"", b"x", b"0\r\n\r\n" * 3000, bytes(range(256)) * 300])
def test_framing_round_trip(payload):
    assert warc.dechunked(warc.chunked(payload, 100)) == payload
    parts = warc.page_records("<urn:page:1:D>", "http://a b\r\n", payload, "D", None, segment=1000)
    stream = b"".join(p + b"\r\n\r\n" for p in parts)
    read = list(warc.parse(gzip.compress(stream)))
    assert read == list(warc.parse(stream)) and len(read) == len(parts)
    assert b"".join(b for _, b in read).partition(b"\r\n\r\n")[2] == warc.chunked(payload)
    if len(parts) > 1:
        assert [int(f["warc-segment-number"]) for f, _ in read] == list(range(1, len(parts) + 1))
        assert int(read[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in read)


def pages(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (9, "v", "same"), (9, "v", "same"), (3, "u", None), (4, "u", ""),
            (5, "u", "é" * 40_000 + "WARC/1.1\r\n\r\n"), (6, "u", "é" * 40_000 + "WARC/1.1\r\n\r\n"),
            (None, "u", "lonely"), (7, "u\r\nX: y", "long " * 30_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("extra"))


def test_pages_come_back(spark):
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark), segment=500).drop("payload_digest").collect()), key=str)
    e = len(("é" * 40_000 + "WARC/1.1\r\n\r\n").encode())
    assert got == sorted([
        (1, 4, "revisit", 9), (2, 4, "revisit", 9), (9, 4, "response", None), (9, 4, "response", None),
        (3, 0, "revisit", 4), (4, 0, "response", None), (5, e, "revisit", 6), (6, e, "response", None),
        (None, 6, "response", None), (7, 150_000, "response", None)], key=str)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_texts_are_whole_and_small_payloads_stay(spark):
    path = fresh_dir(spark, "warc-test")
    warc.write(pages(spark), path, segment=700, least_bytes=5)
    found = warc.records(spark, path)
    whole = {r.payload.decode() for r in warc.payloads(warc.reassembled(found)).collect()}
    assert whole == {r.html or "" for r in pages(spark).collect()}
    assert found.filter("type = 'revisit'").count() == 1


def test_missing_segments_stop_the_job(spark):
    path = fresh_dir(spark, "warc-test")
    warc.write(pages(spark).filter("page_id = 7"), path, segment=1000)
    found = warc.records(spark, path)
    last = found.agg(F.max("segment")).first()[0]
    for gone in (1, 3, last):
        with pytest.raises(Exception, match="segments missing"):
            warc.reassembled(found.filter(F.coalesce(F.col("segment"), F.lit(0)) != gone)).collect()
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    assert list(warc.parse(io.BytesIO(b"").read())) == []


def test_bitmap_never_misses(spark):
    ids = spark.range(5000).select((F.col("id") * 7919 - 20_000_000).alias("id"))
    bits = bitmap(ids)
    values = np.array([r.id for r in ids.collect()])
    assert hits(values, bits).all() and hits(values + 1, bits).mean() < 0.05


def test_pipeline_on_given_and_odd_rows(spark, odd_documents, no_documents):
    final = corpus_pipeline.run(spark, SF)
    assert final.count() > 100 and "ids_sha256" in final.columns
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()


def mixed(rows):
    """How often the mix takes each document of (doc_id, text, source)."""
    sized = collections.defaultdict(list)
    for doc, text, source in rows:
        u = (int(hashlib.md5(f"0:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        sized[source].append((u, doc, len(words_of(text))))
    names = sorted(sized, key=lambda x: (x is None, x))
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    size = {name: sum(n for *_, n in sized[name]) for name in names}
    lacking, unfilled, target = 1.5 * sum(size.values()), list(names), {}
    while unfilled:
        level = lacking / sum(weight[x] for x in unfilled)
        full = [x for x in unfilled if 2 * size[x] <= level * weight[x]]
        target |= {x: 2 * size[x] if full else level * weight[x] for x in full or unfilled}
        lacking -= sum(target[x] for x in full)
        unfilled = [x for x in unfilled if x not in target]
    out = collections.Counter()
    for name in names:
        whole = math.floor(target[name] / size[name])
        rest, before, last = target[name] - whole * size[name], 0, 0
        for u, _, n in sorted(sized[name]):
            if rest > 0 and before + n / 2 <= rest:
                last = u
            before += n
        out.update({doc: whole + (u <= last) for u, doc, _ in sized[name]})
    return +out


def test_pipeline_stages_agree_with_brute_force(spark, monkeypatch):
    paths, models = {}, {}

    def keeping(box, name, make):
        return lambda *given: box.setdefault(name, make(*given))

    monkeypatch.setattr(corpus_pipeline, "fresh_dir", lambda spark, name: paths.setdefault(name, fresh_dir(spark, name)))
    monkeypatch.setattr(corpus_pipeline, "quality_model", keeping(models, "quality", corpus_pipeline.quality_model))
    monkeypatch.setattr(langid, "learn_from", keeping(models, "language", langid.learn_from))
    final = corpus_pipeline.run(spark, SF).collect()

    def rows(df):
        return sorted((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())

    left = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    n = [len(left)]

    def stage(name, want):
        got = rows(spark.read.parquet(paths[name]))
        assert got == sorted(want), name
        n.append(len(got))
        return got

    left = stage("quality", [r for r in left if quality.scores(pa.array([r[1]]), models["quality"])[0] >= 0.5])

    def known(text):
        _, _, (lang,), (share,) = langid._of_texts([text or ""], models["language"])
        return lang != "und" and share >= 0.5

    left = stage("language", [r for r in left if known(r[1])])
    stays = {doc for doc, shingles, low in components([r[:2] for r in left]) if doc == low or not shingles}
    left = stage("near_duplicates", [r for r in left if r[0] in stays])
    assert len(left) < n[-2]  # near copies were there to drop
    copies = mixed(left)
    left = stage("mix", [r for r in left for _ in range(copies[r[0]])])
    want = []
    for doc, text, _ in left:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in final) == sorted(want)
