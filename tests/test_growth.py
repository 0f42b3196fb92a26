"""What must not grow with the rounds of a loop or the size of a table."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from talkmine.operators import components
from talkmine.operators import enrichment as en
from talkmine.operators import evolution as ev
from talkmine.operators import graph as g
from talkmine.operators import keyword_index as ki
from talkmine.operators import neighbors as nb
from talkmine.operators import participants as p
from talkmine.session import cut_lineage


def guessed_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_of_components_do_not_multiply_guessed_sizes(spark):
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.connected(chain)
    assert found.count() == 3001 and found.agg(F.max("component")).first()[0] == 0
    assert guessed_bits(found) < 64
    more = components.merged(found, spark.createDataFrame([(0, 5000), (7000, 7001)], "a long, b long"))
    assert {tuple(r) for r in more.filter("node > 2999").collect()} == {(3000, 0), (5000, 0), (7000, 7000), (7001, 7000)}


def test_batches_of_mentions_do_not_multiply_guessed_sizes(spark):
    held = (None, None)
    for said in (["anna", "bob"], ["annb", "bobb"], ["abnb", "zoe"]):
        held = p.more_entities(spark.createDataFrame([(n,) for n in said], "name string"), *held)
    assert max(guessed_bits(t) for t in held) < 64
    canonical = {r["alias"]: r["canonical"] for r in p.canonical_names(*held).collect()}
    assert canonical == {"anna": "abnb", "annb": "abnb", "abnb": "abnb", "bob": "bob", "bobb": "bob", "zoe": "zoe"}


def test_rows_of_frequent_terms_are_not_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(f"c{i % 50}", t, 1) for i in range(200) for t in ("often", "also")] + [("c1", "once", 2)],
        "chunk_id string, term string, tf long")
    weights = rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.col("df") * 0.5)
    want = sorted(map(tuple, rows.join(weights, "term").select("chunk_id", "term", "tf", "df", "idf").collect()))
    for frequent in (1_000_000, 100, 1):  # all terms are frequent, but one, none
        monkeypatch.setattr(en, "FREQUENT", frequent)
        found = en.weighed(rows, weights)
        assert sorted(map(tuple, found.select("chunk_id", "term", "tf", "df", "idf").collect())) == want
        if frequent > 1000:
            assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert en.weighed(rows, weights.filter("df < 0")).isEmpty()


def test_terms_that_share_a_slot_are_counted_together(spark):
    words = [f"w{i}" for i in range(60)] + ["w3", "w3"]
    row = spark.createDataFrame([(" ".join(words),), (None,), ("",)], "t string").select(
        en.hash_weights(F.col("t"), 8).alias("v")).collect()
    n = [0] * 8
    for w in words:
        n[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
    length = math.sqrt(sum(x * x for x in n))
    assert [(s["slot"], s["weight"]) for s in row[0]["v"]] == [(i, x / length) for i, x in enumerate(n) if x]
    assert row[1]["v"] is None and row[2]["v"] == []


def test_a_search_of_all_leaves_follows_no_query_through_the_tree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "ab"[i % 2]) for i in range(700)]
    vectors = cut_lineage(spark.createDataFrame(rows, "chunk_id long, embedding array<float>, topic string"))
    index = nb.build(vectors, root="topic")
    leaves = index.leaves.select("root", "node").distinct().count()
    asked = vectors.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    few = nb.search(asked, index, 3, 2, root="topic")
    assert leaves > 2 and few.select("query_id").distinct().count() == 14

    def never(*_):
        raise AssertionError("a beam of queries times leaves")

    monkeypatch.setattr(nb, "descend", never)
    found = nb.search(asked, index, 3, leaves, root="topic", skip_self=True)
    unit = np.array([v for _, v, _ in rows], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    rows = found.orderBy("query_id", "rank").collect()
    for q in range(0, 700, 50):
        want = sorted((-near[q, i], i) for i in range(q % 2, 700, 2) if i != q)[:3]
        got = [(-r["score"], r["chunk_id"]) for r in rows if r["query_id"] == q]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_for_many_rows_at_once(spark):
    texts = ["b a b \u00e9", "", None, " ".join(f"w{i % 50}" for i in range(3000)), "\U0001F600 \uff21"]
    rows = spark.createDataFrame(list(enumerate(texts * 700)), "id long, t string").coalesce(1)
    found = rows.select("id", en.term_counts(F.split("t", " ")).alias("c"))
    assert "ArrowEvalPython" in plan(found)
    for r in found.collect():
        text = texts[r["id"] % len(texts)]
        want = None if text is None else sorted((w.encode(), text.split(" ").count(w)) for w in set(text.split(" ")))
        assert (r["c"] and [(c["term"].encode(), c["tf"]) for c in r["c"]]) == want


def test_dense_vectors_are_filled_in_one_step(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "A, b!")], "chunk_id long, chunk_text string")
    found = en.hash_embed(rows, 16)
    assert plan(found).count("ArrowEvalPython") == 1 and "lambda" not in plan(found)
    vectors = {r["chunk_id"]: r["embedding"] for r in found.collect()}
    slot = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in "ab"}
    assert vectors[2] is None and vectors[3] == [0.0] * 16 and slot["a"] != slot["b"]
    assert [vectors[1][slot[w]] for w in "ab"] == [float(np.float32(n / math.sqrt(5))) for n in (2, 1)]
    assert [vectors[4][slot[w]] for w in "ab"] == [float(np.float32(1 / math.sqrt(2)))] * 2
    assert all(sum(x != 0 for x in vectors[i]) == 2 for i in (1, 4))


def test_claims_are_not_sorted_to_find_edges_and_ends(spark):
    """Whole claims are neither sorted nor shuffled to make ids unique or to find the ends of topics."""
    rows = [(str(i % 90), "v1" if i % 2 else None, f"P{i % 7}", f"T{i % 4}", "HIGH", f"{'long ' * 12}{i}", "c") for i in range(100)]
    claims = cut_lineage(spark.createDataFrame(
        rows, """claim_id string, video_id string, speaker string, topic string, attribution_confidence string,
        claim_text string, channel_name string""").withColumn(
            "claim_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.crc32("claim_text") % 300).cast("int"))))
    known = spark.createDataFrame([("v1",), ("v9",)], "video_id string")
    once = claims.filter("cast(claim_id as int) >= 10")
    made = g.claim_edges(once, known)
    assert "Sort" not in plan(made) and plan(made).count("Exchange hashpartitioning") == 1  # the episodes' own
    assert g.claim_nodes(claims).count() == 90
    counts = {r["type"]: r["count"] for r in g.claim_edges(claims, known).groupBy("type").count().collect()}
    sourced = g.claim_nodes(claims).filter("video_id = 'v1'").count()
    assert counts == {"MADE_CLAIM": 90, "ABOUT": 90, "SOURCED_FROM": sourced}
    want = {}
    for r in claims.collect():
        want.setdefault(r["topic"], []).append(r)
    ends = {t: (min(rs, key=lambda r: (r.claim_date, r.claim_id)), max(rs, key=lambda r: r.claim_date).claim_date) for t, rs in want.items()}
    pairs = ev.topic_pairs(claims).collect()
    assert len(pairs) == 4
    for p_ in pairs:
        first, last = ends[p_["topic"]]
        assert (p_["original_claim_id"], p_["original_date"], p_["evolved_date"]) == (first.claim_id, first.claim_date, last)
        assert p_["claim_count"] == len(want[p_["topic"]])


def test_texts_are_read_once_to_weigh_frequent_and_rare_terms(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(60)]
    texts = [". ".join(" ".join(rng.choice(words[: 1 + i % 60], 9)) for _ in range(6)) for i in range(80)]
    rows = [(f"c{i}", f"v{i // 4}", i % 4, t) for i, t in enumerate(texts)] + [("n", "v0", 9, None), ("e", "v0", 10, "")]
    chunks = cut_lineage(spark.createDataFrame(rows, "chunk_id string, video_id string, chunk_window long, chunk_text string"))
    said = {c: [w for w in t.split() for w in [w.strip(".")]] for c, _, _, t in rows[:80]}
    df = {w: sum(w in ws for ws in said.values()) for w in words}
    idf = {w: math.log(82 / n) for w, n in df.items() if n}
    topics, best = set(), {}
    for c, v, window, text in rows[:80]:
        scores = sorted((-round(said[c].count(w) * idf[w], 6), w) for w in set(said[c]))
        topics |= {(c, w, r + 1) for r, (_, w) in enumerate(scores[:5])}
        for pos, s in enumerate(text.split(". ")):
            best.setdefault(v, []).append((-round(sum(idf[w.strip(".")] for w in s.split()) / 9, 6), window, pos))
    for frequent in (1_000_000, 40, 1):  # all terms are frequent, some, none
        monkeypatch.setattr(en, "FREQUENT", frequent)
        made = en.tfidf_topics(chunks)
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert {(r.chunk_id, r.topic, r["rank"]) for r in made.collect()} == topics
        found = en.extract_summary(chunks)
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert {r.video_id: round(r.best_score, 5) for r in found.collect()} == {
            v: round(-min(s)[0], 5) for v, s in best.items()}
        key = lambda df: sorted(map(str, df.collect()))
        twice = chunks.unionByName(chunks)  # a sentence that comes twice is one candidate
        weights = en.term_weights(chunks, least=3)
        assert [s.count("word") for s in key(en.extract_summary(twice, weights=weights))] == [
            2 * s.count("word") for s in key(en.extract_summary(chunks, weights=weights))]


def test_blocks_are_made_where_their_documents_lie(spark, monkeypatch):
    monkeypatch.setattr(ki, "RANGE", 4)
    monkeypatch.setattr(ki, "AT_ONCE", 3)
    rng = np.random.default_rng(2)
    docs = [(None if i == 7 else f"d{i % 37:02}", [(f"w{j}", int(rng.integers(1, 5))) for j in rng.permutation(9)[: i % 7]]) for i in range(40)]
    rows = [(k, sum(n for _, n in t), t) for k, t in docs] + [("none", None, None)]
    made = ki.blocks(spark.createDataFrame(rows, "chunk_id string, doc_len long, terms array<struct<term: string, tf: long>>"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = made.collect()
    assert len({(r.range, r.term) for r in found}) == len(found)
    listed = [(p.doc, p.doc_len, r.term, p.tf) for r in found for p in r.postings]
    key = lambda x: str(x)
    assert sorted(listed, key=key) == sorted([(k, n, w, tf) for k, n, t in rows[:40] for w, tf in t], key=key)
    for r in found:
        assert r.n == len(r.postings) <= 4
        assert (r.most_tf, r.least_len) == (max(p.tf for p in r.postings), min(p.doc_len for p in r.postings))
        order = [(p.doc is not None, p.doc or "", p.tf, p.doc_len) for p in r.postings]
        assert order == sorted(order)
