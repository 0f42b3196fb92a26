import pytest
from pyspark.sql import functions as F

from talkmine.operators import graph as g
from talkmine.operators import participants as p

EPISODE = "video_id string, channel_name string, episode_title string"


@pytest.mark.parametrize("channel,title,want", [
    ("Lex Fridman", "Jeff Bezos: Rockets and Roads | Lex Fridman Podcast #405", ["Jeff Bezos"]),
    ("Lex Fridman", "Lex Fridman: Solo Thoughts", []),
    ("All-In Podcast", "John Mearsheimer vs. Jeffrey Sachs", ["John Mearsheimer", "Jeffrey Sachs"]),
    ("Tim Ferriss", "Chris Sacca — How to Succeed", ["Chris Sacca"]),
    ("Tim Ferriss", "Naval Ravikant and Aaron Stupple — On Kids", ["Naval Ravikant", "Aaron Stupple"]),
    ("Andrew Huberman", "Sleep Well | Huberman Lab Essentials", []),
    ("Chris Williamson", "How To Think - Naval Ravikant (4K)", ["Naval Ravikant"]),
    ("PowerfulJRE", "Joe Rogan Experience #2422 - Jensen Huang", ["Jensen Huang"]),
    ("Acquired", "NVIDIA CEO Jensen Huang", ["Jensen Huang"]),
    ("Ali Abdaal", "Jane Doe: a talk", []),
    ("Nobody Knows", "Jane Doe: a talk", []),
    ("Lenny's Podcast", "Growth lessons | Jane Doe (Acme)", ["Jane Doe"]),
    # The first pattern matches one word only, so the next one is tried.
    ("StarTalk", "Do We Die? With Venki", []),
])
def test_guest_from_title(spark, channel, title, want):
    df = spark.createDataFrame([("v", channel, title)], EPISODE)
    assert p.with_title_guests(df, p.show_table(spark)).first().guests == want


def test_fall_through_and_answers(spark):
    shows = p.show_table(spark, [("S", ["Ann Host"], [r"^([A-Z]\w+ \w+):", r"- ([A-Z]\w+ \w+)$"]), ("Solo", ["Bo Solo"], [])])
    df = spark.createDataFrame([
        ("1", "S", "Ann Host: x - Cy Guest"), ("2", "S", "nothing"), ("3", "Solo", "Cy Guest: x"), ("4", "S", "none")], EPISODE)
    answers = spark.createDataFrame(
        [("2", " Di Found | Ed Found "), ("3", "Not Asked"), ("4", "none"), ("1", "Not Asked")], "video_id string, raw string")
    got = {(r.video_id, r.participant_name): (r.participant_role, r.confidence)
           for r in p.participants(df, shows, answers).collect()}
    assert got == {
        ("1", "Ann Host"): ("HOST", "HIGH"), ("1", "Cy Guest"): ("GUEST", "HIGH"), ("2", "Ann Host"): ("HOST", "HIGH"),
        ("2", "Di Found"): ("GUEST", "MEDIUM"), ("2", "Ed Found"): ("GUEST", "MEDIUM"), ("3", "Bo Solo"): ("HOST", "HIGH"),
        ("4", "Ann Host"): ("HOST", "HIGH")}
    stats = p.extraction_stats(df, shows, answers).first()
    assert tuple(stats) == (4, 1, 1, 2)


def test_all_shows_have_valid_patterns(spark):
    table = p.show_table(spark)
    titles = table.select(F.col("channel_name").alias("video_id"), "channel_name", F.lit("Jane Doe: x | y").alias("episode_title"))
    assert p.with_title_guests(titles, table).count() == 25


def test_names_merge_by_edits(spark):
    names = ["OpenAI"] * 3 + ["Open AI", "OpenA1", "Sam Altman", "Sam Altmann", "Altman", "Ann Lee", "Bob Lee", "Lee", "!!"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.alias: r.canonical for r in p.resolve_entities(df, 1, last_names=True).collect()}
    assert got["Open AI"] == got["OpenA1"] == "OpenAI"
    assert got["Sam Altmann"] == got["Altman"] == got["Sam Altman"]
    assert got["Lee"] == "Lee" and got["Ann Lee"] == "Ann Lee" and "!!" not in got


def test_similar_names_against_all_pairs(spark):
    import itertools
    import random
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "folded string")
    for d in (1, 2):
        want = {(a, b) for a, b in itertools.combinations(words, 2) if distance(a, b) <= d}
        assert {tuple(r) for r in p.similar_names(df, d).collect()} == want


def test_long_chain_is_one_component(spark):
    chain = [f"{i:03d}" for i in range(60)]
    nodes = spark.createDataFrame([(x,) for x in chain + ["zz"]], "folded string")
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "src string, dst string")
    got = {r.vertex: r.component for r in p.connected(nodes, edges).collect()}
    assert set(got[x] for x in chain) == {"000"} and got["zz"] == "zz"


CLAIM = "claim_id string, video_id string, speaker string, attribution_confidence string, topic string"


def test_claim_edges_by_confidence(spark):
    claims = spark.createDataFrame([
        ("1", "v", "Ann", "HIGH", "t"), ("2", "v", "Ann", "LOW", "t"), ("3", "v", "Ann", None, " "), ("4", "v", None, "HIGH", None),
        ("5", "v", "Ann", "UNKNOWN", "t"), ("6", "gone", "unknown", "HIGH", "t")], CLAIM)
    episodes = spark.createDataFrame([("v",)], "video_id string")
    edges = g.claim_edges(claims, episodes)
    kinds = {r.type: r.n for r in edges.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"MADE_CLAIM": 1, "LIKELY_MADE_CLAIM": 2, "DISCUSSED_IN": 2, "ABOUT": 4, "SOURCED_FROM": 5}


def test_person_role_is_the_most_frequent(spark):
    people = spark.createDataFrame([
        ("1", "Ann", "HOST", "a"), ("2", "Ann", "GUEST", "b"), ("3", "Ann", "GUEST", "b")],
        "video_id string, participant_name string, participant_role string, channel_name string")
    claims = spark.createDataFrame([("1", "v", "Cy", "HIGH", "t")], CLAIM)
    got = {r.name: (r.primary_role, r.primary_channel) for r in g.person_nodes(people, claims).collect()}
    assert got == {"Ann": ("GUEST", "b"), "Cy": (None, None)}


def test_hops_from_a_hub(spark):
    edges = spark.createDataFrame(
        [("A", "1", "B", "2"), ("B", "2", "C", "3"), ("D", "4", "C", "3"), ("D", "5", "C", "9")],
        "src_label string, src string, dst_label string, dst string")
    got = {r.id: r.hops for r in g.k_hop(edges, "A", "1", 3).collect()}
    assert got == {"1": 0, "2": 1, "3": 2, "4": 3}


def test_graph_is_written_once(spark, tmp_path):
    from talkmine.sources.sinks import write_graph
    nodes = spark.createDataFrame([("Person", "Ann"), ("Person", "Ann")], "label string, id string")
    edges = spark.createDataFrame([("KNOWS", "Ann", "Bob")], "type string, src string, dst string")
    for mode in ("overwrite", "append"):
        write_graph(nodes, edges, str(tmp_path), mode)
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == 1
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 1
