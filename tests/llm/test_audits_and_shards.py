"""Sharding, the audit of filters, and the repair of conversations."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF, documents
from tests.oracle_check import compare, duck

from talkmine.llm import conversation_repair as cr
from talkmine.llm import filter_audit, sharding
from talkmine.llm.queries import ORACLES, QUERIES
from talkmine.session import fresh_dir

LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_conversation_repair"])
def test_query_agrees_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


# --- filter audit ------------------------------------------------------------------------------

def fails_of(rows):
    """Plain failures A to E of (doc_id, text, source) rows."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append((len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier))
    return out


def plain_audit(rows, good, toxic):
    want = {}
    fails = fails_of(rows)
    for part in {s or "" for _, _, s in rows}:
        own = [(f, r[0]) for f, r in zip(fails, rows) if (r[2] or "") == part]
        removals = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = list(own)
            for step, i in enumerate(order):
                gone = [d for d in left if d[0][i]]
                left = [d for d in left if not d[0][i]]
                removals[i] += len(gone)
                want[part, "".join("ABCDE"[x] for x in order), step + 1] = [
                    len(left), len(gone), sum(f[i] for f, _ in own) - len(gone),
                    sum(f[i] and sum(f) == 1 for f, _ in own), sum(d in good for _, d in gone),
                    sum(d in toxic for _, d in gone), i]
        for key, counts in want.items():
            if key[0] == part:
                counts[6] = removals[counts[6]]
    return want


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.NAMES] for r in df.collect()}


def test_audit_of_odd_rows(spark, odd_documents):
    more = documents(spark, [(20, "A# " * 300, "en", ""), (21, "A# " * 300, "en", "a"), (None, None, None, "a"), (22, None, "en", "a")])
    docs = odd_documents.unionByName(more, allowMissingColumns=True).withColumn("part", F.lit("x")).withColumn("cell", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 1), (1, None, 0), (21, 1, None), (22, 0, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert audit_rows(filter_audit.audit(docs, labels)) == plain_audit(rows, {1, 21}, {1, 22})


def test_audit_of_many_copies(spark):
    """A text that a third of all rows hold, and rows repeated in full."""
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} * {'word ' * i}", "hot" if i % 2 else None) for i in range(90)]
    rows += rows[:5]
    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 90, 2)], LABELS)
    assert audit_rows(filter_audit.audit(docs, labels)) == plain_audit(
        rows, {i for i in range(0, 90, 2) if i % 2}, {i for i in range(0, 90, 6)})


def test_audit_of_nothing(spark, no_documents):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_documents, labels).count() == 0
    one = documents(spark, [(1, "a b", "en", "s")])
    found = filter_audit.audit(one, labels)
    assert found.count() == 600 and found.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_shapley_values_add_up(spark, given):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    audited = filter_audit.audit(given, labels)
    removed = {r[0]: r[1] for r in audited.filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("removed")).collect()}
    shares = filter_audit.shapley_values(audited).groupBy("part").agg(F.sum("removals")).collect()
    assert all(abs(r[1] - removed[r[0]]) < 1e-9 for r in shares)


# --- shards --------------------------------------------------------------------------------------

def check_laws(packed, docs, shards):
    rows = packed.collect()
    sizes = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                                for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_shards_of_odd_rows(spark, odd_documents, no_documents):
    check_laws(sharding.pack(odd_documents, 3), odd_documents, 3)
    assert sharding.pack(no_documents).count() == 0
    assert sharding.pack(no_documents).columns == sharding.pack(odd_documents).columns


def test_shards_are_nearly_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 100)
    rng = random.Random(3)
    lengths = [rng.randint(1, 400) for _ in range(9000)]
    rows = [(i, "one hot text" if i % 3 == 0 else f"{i % 2999} " + ("x" if i % 3 == 1 else "a b ") * lengths[i % 2999], "en", "s")
            for i in range(9000)]
    rows += [(3, "one hot text", "en", "s")] * 2000  # a row repeated in full
    docs = documents(spark, rows)
    found = check_laws(sharding.pack(docs, 10), docs, 10)
    for size in (lambda r: r.size, lambda r: 1):
        load = collections.Counter()
        for r in found:
            load[r.shard] += size(r)
        assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 10
    where = collections.defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"one hot text")
    assert len(where[hot]) > 1 and all(len(s) == 1 for crc, s in where.items() if crc != hot)
    again = sharding.pack(docs.orderBy(F.desc("doc_id")).repartition(3), 10)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_place_takes_the_highest_dot_product():
    rng = np.random.default_rng(1)
    vectors = rng.random((200, 3)) / 20
    got = sharding.place(vectors, 4)
    left = [[1.0] * 3 for _ in range(4)]
    for i in sorted(range(200), key=lambda i: (-max(vectors[i]), i)):
        dots = [sum(a * b for a, b in zip(shard, vectors[i])) for shard in left]
        assert dots[got[i]] >= max(dots) - 1e-9
        left[got[i]] = [a - b for a, b in zip(left[got[i]], vectors[i])]


def test_query_packs_the_given_documents(spark, given):
    rows = check_laws(QUERIES["op11_sharding"](spark, SF), given, 40)
    items = collections.Counter()
    for r in rows:
        items[r.shard] += r.size
    assert max(items.values()) <= max(r.size for r in rows) + sum(items.values()) / 40


def test_written_shards_hold_all_rows(spark, odd_documents):
    docs = odd_documents.withColumn("slot", F.lit("theirs"))
    path = fresh_dir(spark, "shards")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    own = [c for c in docs.columns if c != "slot"]
    assert sorted(map(str, back.select(*own).collect())) == sorted(map(str, docs.select(*own).collect()))
    for shard in range(4):
        slots = [r.slot for r in back.filter(F.col("shard") == shard).collect()]
        assert sorted(slots) == list(range(len(slots)))


# --- conversations -------------------------------------------------------------------------------

def plain_repair(rows):
    """Counts, cost, audit and hash of one conversation by best-first search over edits."""
    seen, marks = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for turn, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marks.append(fault)
    for a, b in itertools.pairwise(rows):
        counts["illegal"] += a[1][:1] + b[1][:1] not in ("su", "ua", "au")
    turns = [r[0] for r in rows if r[0] is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def follows(done, initial):
        return re.fullmatch(r"s?(ua)*u?", done + initial) is not None

    queue = [(0, "", 0, "", [])]
    best = {}
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return {**counts, "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        key = at, roles[-1:]
        if best.get(key, (cost, audit)) < (cost, audit):
            continue
        best[key] = cost, audit
        for initial, role in (("u", "user"), ("a", "assistant")):
            if follows(roles, initial):
                heapq.heappush(queue, (cost + 2, audit + "I", at, roles + initial, [*lines, f"{role}:"]))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles, lines))
            if marks[at] not in ("blank", "duplicate"):
                more = marks[at] == "truncated"
                if role[:1] and follows(roles, role[:1]):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + role[:1], [*lines, f"{role}:{text}"]))
                for initial, new in (("u", "user"), ("a", "assistant")):
                    if follows(roles, initial):
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, roles + initial, [*lines, f"{new}:{text}"]))
    raise AssertionError


def plain_damage(rows):
    kept = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
            for conv, found in kept.items()}


def repaired(df, **more):
    return {r.conv_id: {"blank": r.blank, "duplicate": r.duplicate, "truncated": r.truncated, "illegal": r.illegal,
                        "gaps": r.gaps, "cost": r.cost, "audit": r.audit, "sha": r.repaired_sha256}
            for r in cr.repair(cr.damaged(df), **more).collect()}


def some_turns(seed, convs=60, longest=14):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "User", "", None, "s", "u", "a"], ["Yes.", "no", " \t", "", None, "Well?", "a.\n", "b\n!  "]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, longest)):
            rows.append((None if conv == 1 else conv, rng.choice([turn, turn, turn, turn * 2, None, 3]),
                         rng.choice(roles[:3] * 3 + roles), rng.choice(texts) if rng.random() < .7 else f"t{turn}."))
    return rows


def test_repair_of_odd_conversations(spark):
    for seed in (1, 2):
        rows = some_turns(seed)
        df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit("extra")).withColumn("first", F.lit(0))
        assert repaired(df) == {c: plain_repair(r) for c, r in plain_damage(rows).items()}


def test_conversations_over_many_ranges(spark, monkeypatch):
    """Ranges shorter than conversations, chunks shorter than texts, a conversation with most rows."""
    monkeypatch.setattr(cr, "STRETCH", 3)
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["Yes.", "no", f"text {t}.", f"x{t}"])) for t in range(400)]
    rows += some_turns(8, 12) + [(6, None, "user", f"r{i % 40}.") for i in range(120)] + [(7, 2, "assistant", "same.")] * 90
    df = spark.createDataFrame(rows, TURNS)
    whole = repaired(df, range_rows=10_000)
    assert repaired(df, range_rows=9) == whole
    assert {c: f for c, f in whole.items() if c != 5} == {c: plain_repair(r) for c, r in plain_damage(rows).items() if c != 5}
    assert len(whole[5]["audit"]) >= 370 and cr.repair(cr.damaged(df.limit(0))).count() == 0


def test_long_runs_by_powers():
    symbol = ("u", False)
    step = cr.power(symbol, 0)
    rest = cr.END
    for _ in range(1000):
        rest = cr.onto(step, rest)
    assert cr.before_run(symbol, 1000, cr.END) == rest
    runs = [[symbol, 9000], [cr.GO, 1 << 40], [("a", True), 3]]
    letters = list(cr.unroll(runs, cr.START, cr.END, True))
    symbols = iter([symbol] * 9000 + [("a", True)] * 3)
    total = 0
    for letter, often, _, chosen in letters:
        more = chosen and next(symbols)[1] and letter != "D"
        total += {"D": 3, "I": 2, "K": 0, "R": 2}[letter] * often + more
    assert total == cr.onto(cr.run_matrix(runs), cr.END)[cr.START]


def test_undamaged_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho!"), (2, 0, "assistant", None)], TURNS)
    found = {r.conv_id: (r.cost, r.audit) for r in cr.repair(cr.undamaged(df)).collect()}
    assert found == {1: (0, "KK"), 2: (3, "D")}
