"""Hosts and guests per episode, and merging of near-duplicate names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.ranking import literal_table, skew_join, top_k
from talkmine.functions.text import pct, quote, strip_ws
from talkmine.operators import components
from talkmine.session import cut_lineage, stored

SHOW_SCHEMA = "channel_name string, hosts array<string>, patterns array<struct<pattern:string,groups:int>>"
COLUMNS = [
    "video_id", "participant_name", "participant_role", "extraction_method", "confidence",
    "channel_name", "episode_title",
]


def show_table(spark: SparkSession, shows=fixed.SHOWS) -> DataFrame:
    """Hosts and title patterns per channel. Patterns see Unicode letters and ``\\n`` line ends."""
    rows = [
        (name, hosts, [("(?Ud)" + p, re.compile(p).groups) for p in patterns])
        for name, hosts, patterns in shows
    ]
    return literal_table(spark, rows, SHOW_SCHEMA)


def clean_name(c: Column) -> Column:
    """Drop a trailing parenthesis and everything after a pipe, episode marks included."""
    c = strip_ws(F.regexp_replace(strip_ws(c), r"\s*\([^)]+\)\s*$", ""))
    return strip_ws(F.regexp_replace(c, r"\s*\|.*$", ""))


def _participant(df: DataFrame, name: Column, role: str, method: str, confidence: str) -> DataFrame:
    return df.select(
        "video_id", name.alias("participant_name"), F.lit(role).alias("participant_role"),
        F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence"),
        "channel_name", "episode_title")


def hosts(episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """Every known host of the channel."""
    rows = episodes.join(shows.select("channel_name", "hosts"), "channel_name")
    return _participant(rows.withColumn("h", F.explode("hosts")), F.col("h"), "HOST", "MANUAL", "HIGH")


def with_title_guests(episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """Add ``guests``: names from the first title pattern that leaves any name standing.

    All patterns of a channel are tried inside the row, so titles are never multiplied.
    """
    generic = f"(?i)^(?:{'|'.join(quote(g) for g in fixed.GENERIC_NAMES)})$"

    def stands(name: Column) -> Column:
        known = F.exists("hosts", lambda h: F.contains(F.lower(name), F.lower(h)))
        return ~known & ~name.rlike(generic) & name.rlike(r"(?U)\S\s+\S")

    def names(p: Column) -> Column:
        def group(i: int) -> Column:
            return F.call_function("regexp_extract", F.col("episode_title"), p["pattern"], F.lit(i))

        second = F.when(p["groups"] >= 2, group(2)).otherwise("")
        return F.filter(F.transform(F.array(group(1), second), clean_name), stands)

    rows = episodes.join(shows, "channel_name", "left")
    tried = F.filter(F.transform("patterns", names), lambda found: F.size(found) > 0)
    return rows.withColumn("guests", F.coalesce(F.get(tried, F.lit(0)), F.array().cast("array<string>")))


def guests_from_titles(episodes: DataFrame, shows: DataFrame) -> DataFrame:
    rows = with_title_guests(episodes, shows).withColumn("g", F.explode("guests"))
    return _participant(rows, F.col("g"), "GUEST", "TITLE_PARSE", "HIGH")


def needs_fallback(episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """Episodes of channels with guests whose title gave none."""
    return with_title_guests(episodes, shows).filter(
        (F.size("guests") == 0) & (F.size("patterns") > 0))


def parse_guest_fallback(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per name in a ``name | name`` answer; NONE and blank answers give none."""
    text = strip_ws(F.coalesce(raw, F.lit("")))
    names = F.filter(F.transform(F.split(text, r"\|"), strip_ws), lambda n: n != "")
    return answers.filter((text != "") & (F.upper(text) != "NONE")).select(
        "video_id", F.explode(names).alias("participant_name"))


def guests_from_answers(episodes: DataFrame, shows: DataFrame, answers: DataFrame) -> DataFrame:
    rows = needs_fallback(episodes, shows).join(parse_guest_fallback(answers), "video_id")
    return _participant(rows, F.col("participant_name"), "GUEST", "LLM_INFERRED", "MEDIUM")


def participants(episodes: DataFrame, shows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Hosts and guests of each episode, one row per episode and name."""
    found = hosts(episodes, shows).unionByName(guests_from_titles(episodes, shows))
    if answers is not None:
        found = found.unionByName(guests_from_answers(episodes, shows, answers))
    # A name found twice keeps its surest row: host before guest, title before answer.
    surest = F.struct(
        (F.col("participant_role") != "HOST").alias("r"), (F.col("confidence") != "HIGH").alias("c"))
    rest = [c for c in COLUMNS if c not in ("video_id", "participant_name")]
    return found.groupBy("video_id", "participant_name").agg(
        F.min_by(F.struct(*rest), surest).alias("p")).select("video_id", "participant_name", "p.*").select(*COLUMNS)


def extraction_stats(episodes: DataFrame, shows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Episodes by how their guest was found."""
    by_title = with_title_guests(episodes, shows)
    answered = F.lit(False)
    if answers is not None:
        hit = parse_guest_fallback(answers).select("video_id").distinct().withColumn("_hit", F.lit(True))
        by_title = by_title.join(hit, "video_id", "left")
        answered = F.coalesce("_hit", F.lit(False)) & (F.coalesce(F.size("patterns"), F.lit(0)) > 0)
    regex = F.size("guests") > 0
    return by_title.agg(
        F.count("*").alias("episodes"), F.count_if(regex).alias("regex_hit"),
        F.count_if(~regex & answered).alias("fallback_hit"),
        F.count_if(~regex & ~answered).alias("no_guest"))


def guest_coverage(people: DataFrame) -> DataFrame:
    guest = F.count_distinct(F.when(F.col("participant_role") == "GUEST", F.col("video_id")))
    return people.agg(
        F.count_distinct("video_id").alias("total_episodes"), guest.alias("episodes_with_guest"),
    ).withColumn("guest_coverage_pct", pct(F.col("episodes_with_guest"), F.col("total_episodes")))


def top_participants(people: DataFrame, k: int = 20) -> DataFrame:
    groups = people.groupBy("participant_name", "participant_role").agg(F.count("*").alias("episode_count"))
    return top_k(groups, [F.desc("episode_count"), "participant_name", "participant_role"], k)


def participant_map(people: DataFrame) -> DataFrame:
    """Hosts and guests of each episode as two comma-separated strings."""
    sure = people.filter(F.col("confidence").isin("HIGH", "MEDIUM")).select(
        "video_id", "participant_name", "participant_role").distinct()

    def listed(role: str) -> Column:
        names = F.array_sort(F.collect_list(
            F.when(F.col("participant_role") == role, F.col("participant_name"))))
        return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("Unknown"))

    return sure.groupBy("video_id").agg(listed("HOST").alias("hosts"), listed("GUEST").alias("guests"))


def with_participants(chunks: DataFrame, people: DataFrame) -> DataFrame:
    joined = chunks.join(participant_map(people), "video_id", "left")
    return joined.fillna("Unknown", ["hosts", "guests"])


# --- names that differ by a few letters -----------------------------------------------------

def folded_name(c: Column) -> Column:
    """Lower case letters and digits only, so spacing and punctuation do not matter."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _shorter(words: Column) -> Column:
    """All words, and all words with one character left out."""
    def cut(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, cut))))


def similar_names(names: DataFrame, max_dist: int = 1, fresh: DataFrame | None = None) -> DataFrame:
    """All pairs of distinct folded names within ``max_dist`` edits, without comparing all; with
    ``fresh``, some of the names, only pairs that hold one of these.

    Two such names share a word that each yields by leaving out at most ``max_dist``
    characters, so an equi-join on those words finds every pair; the edit distance then
    decides. The words of a name depend on its length only, and a word is shared by few
    names because the names are distinct.
    """
    words = F.array("folded")
    for _ in range(max_dist):
        words = _shorter(words)
    keyed, other = (df.select("folded", F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("word"))
                    for df in (names, names if fresh is None else fresh))
    a, b = keyed.alias("a"), other.alias("b")
    apart = F.col("a.folded") < F.col("b.folded") if fresh is None else F.col("a.folded") != F.col("b.folded")
    return a.join(b, (F.col("a.word") == F.col("b.word")) & apart).filter(
        F.levenshtein(F.col("a.folded"), F.col("b.folded"), max_dist) >= 0
    ).select(F.least("a.folded", "b.folded").alias("src"), F.greatest("a.folded", "b.folded").alias("dst")).distinct()


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest vertex of each connected component, as (vertex, component)."""
    found = components.connected(edges.select("src", "dst")).withColumnRenamed("node", "vertex")
    return vertices.select(F.col("folded").alias("vertex")).join(found, "vertex", "left").select(
        "vertex", F.coalesce("component", "vertex").alias("component"))


def resolve_entities(names: DataFrame, max_dist: int = 1, name: str = "name", last_names: bool = False) -> DataFrame:
    """Canonical name of each spelling: the most frequent one among near-duplicates.

    With ``last_names``, a single word joins the one full name that ends in it, if only one
    does. Returns (alias, canonical, mentions).
    """
    spelled = names.filter(folded_name(F.col(name)) != "").groupBy(F.col(name).alias("alias")).agg(
        F.count("*").alias("mentions")).withColumn("folded", folded_name(F.col("alias")))
    spelled = cut_lineage(spelled)
    distinct = spelled.select("folded").distinct()
    edges = similar_names(distinct, max_dist)
    if last_names:
        words = F.split(F.trim("alias"), r"\s+")
        full = spelled.filter(F.size(words) > 1).groupBy(
            F.lower(F.element_at(words, -1)).alias("word")
        ).agg(F.min("folded").alias("dst"), F.max("folded").alias("other")).filter("dst = other")
        single = spelled.filter(F.size(words) == 1).select(
            F.lower(F.trim("alias")).alias("word"), F.col("folded").alias("src"))
        edges = edges.unionByName(single.join(full, "word").select("src", "dst")).distinct()
    groups = connected(distinct, edges)
    return canonical_names(spelled, groups)


def canonical_names(spelled: DataFrame, groups: DataFrame) -> DataFrame:
    """(alias, canonical, mentions) from spellings (alias, mentions, folded) and the components of folded names."""
    grouped = spelled.join(groups, F.col("folded") == F.col("vertex")).select("alias", "mentions", "component")
    best = grouped.groupBy("component").agg(
        F.min_by("alias", F.struct(-F.col("mentions"), F.col("alias"))).alias("canonical"), F.count("*").alias("n"))
    return skew_join(grouped, best, "component", "n").select("alias", "canonical", "mentions")


def more_entities(names: DataFrame, spelled: DataFrame | None = None, groups: DataFrame | None = None,
                  max_dist: int = 1, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """The tables of ``canonical_names`` after more mentions have come.

    Only names not held yet are compared, with each other and those held, and the links found are
    merged into the stored components; without held tables this is the first batch.
    """
    counted = names.filter(folded_name(F.col(name)) != "").groupBy(F.col(name).alias("alias")).agg(
        F.count("*").alias("mentions")).withColumn("folded", folded_name(F.col("alias")))
    if spelled is None:
        spelled = stored(counted)
        distinct = spelled.select("folded").distinct()
        return spelled, stored(connected(distinct, similar_names(distinct, max_dist)))
    after = stored(spelled.unionByName(counted).groupBy("alias", "folded").agg(F.sum("mentions").alias("mentions")))
    distinct = stored(after.select("folded").distinct())
    fresh = stored(distinct.join(groups.select(F.col("vertex").alias("folded")), "folded", "left_anti"))
    held = groups.unionByName(fresh.select(F.col("folded").alias("vertex"), F.col("folded").alias("component")))
    merged = components.merged(held.withColumnRenamed("vertex", "node"), similar_names(distinct, max_dist, fresh))
    return after, stored(merged.withColumnRenamed("node", "vertex"))
