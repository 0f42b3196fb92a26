"""Property graph of channels, episodes, people, topics and claims as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine.functions.ranking import collect_distinct, skew_join, top_k
from talkmine.functions.text import icontains, present
from talkmine.session import cut_lineage

EDGE_COLUMNS = ["type", "src_label", "src", "dst_label", "dst", "role", "confidence", "method", "drift_type"]

# Nodes of a search layer that may be sent to every task.
SMALL_LAYER = 100_000


# --- nodes -------------------------------------------------------------------------------

def channel_nodes(channels: DataFrame) -> DataFrame:
    return channels.groupBy("channel_name").agg(
        F.min("channel_id").alias("channel_id"), F.min("genre").alias("genre"),
        F.min("youtube_url").alias("youtube_url"))


def episode_nodes(chunks: DataFrame) -> DataFrame:
    """One node per episode; its link is that of the first chunk."""
    first = F.struct("chunk_start_sec", "chunk_id")
    return chunks.filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(
        F.min_by(F.struct("episode_title", "channel_name", "publish_date", "youtube_url", "genre"), first).alias("e")
    ).select(
        "video_id", F.col("e.episode_title").alias("title"), "e.channel_name",
        F.date_format("e.publish_date", "yyyy-MM-dd").alias("publish_date"), "e.youtube_url", "e.genre")


def speaker_known(c: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("", "UNKNOWN")


def _edge_kind() -> Column:
    """Edge type by who said it and how sure that is."""
    confidence = F.upper(F.coalesce("attribution_confidence", F.lit("")))
    return (
        F.when(~speaker_known(F.col("speaker")) | (confidence == "UNKNOWN"), "DISCUSSED_IN")
        .when(confidence == "HIGH", "MADE_CLAIM").otherwise("LIKELY_MADE_CLAIM"))


def person_nodes(people: DataFrame, claims: DataFrame) -> DataFrame:
    """Participants, with their most frequent role and channel, and speakers of claims."""
    counted = people.filter(F.col("participant_name").isNotNull()).groupBy(
        F.col("participant_name").alias("name"), "participant_role", "channel_name"
    ).agg(F.count_distinct("video_id").alias("n"))
    known = counted.groupBy("name").agg(F.min_by(
        F.struct("participant_role", "channel_name"),
        F.struct(-F.col("n"), F.col("participant_role"), F.col("channel_name"))).alias("p"))
    speakers = claims.filter(_edge_kind() != "DISCUSSED_IN").select(F.col("speaker").alias("name")).distinct()
    return known.join(speakers, "name", "full").select(
        "name", F.col("p.participant_role").alias("primary_role"), F.col("p.channel_name").alias("primary_channel"))


def topic_nodes(claims: DataFrame) -> DataFrame:
    return claims.filter(present(F.col("topic"))).select(F.col("topic").alias("name")).distinct()


def _one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same on every run: the one whose text form comes first.

    Keys aren't null. Only they are shuffled, and the rows of keys that do repeat.
    """
    repeated = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    count = repeated.count()
    if count == 0:
        return rows
    repeated = F.broadcast(repeated) if count <= SMALL_LAYER else repeated
    rest = [c for c in rows.columns if c not in keys]
    chosen = rows.join(repeated, keys, "left_semi").groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
    return rows.join(repeated, keys, "left_anti").select(*rows.columns).unionByName(chosen)


def claim_nodes(claims: DataFrame) -> DataFrame:
    return _one_per_key(claims.filter(F.col("claim_id").isNotNull()), ["claim_id"])


def nodes(chunks: DataFrame, people: DataFrame, claims: DataFrame, channels: DataFrame) -> DataFrame:
    """All nodes as (label, id)."""
    parts = {
        "Channel": channel_nodes(channels).select(F.col("channel_name").alias("id")),
        "Episode": episode_nodes(chunks).select(F.col("video_id").alias("id")),
        "Person": person_nodes(people, claims).select(F.col("name").alias("id")),
        "Topic": topic_nodes(claims).select(F.col("name").alias("id")),
        "Claim": claims.filter(F.col("claim_id").isNotNull()).select(F.col("claim_id").alias("id")).distinct(),
    }
    stacked = [df.select(F.lit(label).alias("label"), "id") for label, df in parts.items()]
    out = stacked[0]
    for df in stacked[1:]:
        out = out.unionByName(df)
    return out


# --- edges -------------------------------------------------------------------------------

def _edge(df: DataFrame, kind, src_label: str, src: str, dst_label: str, dst: str, **props: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    extra = [
        (F.col(props[p]) if p in props else F.lit(None).cast("string")).alias(p)
        for p in ("role", "confidence", "method", "drift_type")]
    return df.select(
        kind.alias("type"), F.lit(src_label).alias("src_label"), F.col(src).alias("src"),
        F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst"), *extra)


def drop_dangling(edges: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Keep edges whose ``side`` (src or dst) is among ``ids``, a table with one column. Ids that a
    count shows to be few, such as channels, are sent to the edges, of which one may have very many."""
    ids = ids.toDF(side).distinct()
    return edges.join(F.broadcast(ids) if ids.count() <= SMALL_LAYER else ids, side, "left_semi")


def belongs_to(chunks: DataFrame, channels: DataFrame) -> DataFrame:
    pairs = chunks.filter(F.col("video_id").isNotNull() & F.col("channel_name").isNotNull()).select(
        "video_id", "channel_name").distinct()
    return drop_dangling(
        _edge(pairs, "BELONGS_TO", "Episode", "video_id", "Channel", "channel_name"),
        channels.select("channel_name"), "dst")


def appeared_on(people: DataFrame, episodes: DataFrame) -> DataFrame:
    rows = people.filter(F.col("participant_name").isNotNull() & F.col("video_id").isNotNull())
    rows = _one_per_key(rows, ["participant_name", "video_id"])
    return drop_dangling(
        _edge(rows, "APPEARED_ON", "Person", "participant_name", "Episode", "video_id",
              role="participant_role", confidence="confidence", method="extraction_method"),
        episodes.select("video_id"), "dst")


def claim_edges(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    """All edges of each claim, unfolded from one pass over the claims.

    MADE_CLAIM or LIKELY_MADE_CLAIM from a known speaker, else DISCUSSED_IN to the episode;
    ABOUT to the topic; SOURCED_FROM to the episode. Edges to unknown episodes are dropped.
    """
    # No episode is the empty id.
    rows = claim_nodes(claims).withColumns({
        "_kind": _edge_kind(), "video_id": F.coalesce("video_id", F.lit(""))}).select(
        "claim_id", "video_id", "speaker", "topic", "_kind")
    known = episodes.select("video_id").distinct().withColumn("_known", F.lit(True))
    if known.count() <= SMALL_LAYER:
        rows = rows.join(F.broadcast(known), "video_id", "left")
    else:
        # One row per episode of any claim, with the number of its claims, so that an episode
        # with a large share of all claims is joined by broadcast.
        cited = rows.groupBy("video_id").agg(F.count("*").alias("_n")).join(known, "video_id", "left")
        rows = skew_join(rows, cited, "video_id", "_n")
    here, said = F.coalesce("_known", F.lit(False)), F.col("_kind") != "DISCUSSED_IN"

    def edge(when: Column, kind: Column, src_label: str, src: str, dst_label: str, dst: str) -> Column:
        return F.when(when, F.struct(
            kind.alias("type"), F.lit(src_label).alias("src_label"), F.col(src).alias("src"),
            F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst")))

    made = F.array_compact(F.array(
        edge(said, F.col("_kind"), "Person", "speaker", "Claim", "claim_id"),
        edge(~said & here, F.col("_kind"), "Claim", "claim_id", "Episode", "video_id"),
        edge(present(F.col("topic")), F.lit("ABOUT"), "Claim", "claim_id", "Topic", "topic"),
        edge(here, F.lit("SOURCED_FROM"), "Claim", "claim_id", "Episode", "video_id")))
    none = F.lit(None).cast("string")
    return rows.select(F.explode(made).alias("e")).select("e.*", *[
        none.alias(c) for c in ("role", "confidence", "method", "drift_type")])


def about(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    return claim_edges(claims, episodes).filter("type = 'ABOUT'")


def sourced_from(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    return claim_edges(claims, episodes).filter("type = 'SOURCED_FROM'")


def evolved_from(evolution: DataFrame, claims: DataFrame) -> DataFrame:
    edges = cut_lineage(_edge(evolution, "EVOLVED_FROM", "Claim", "evolved_claim_id", "Claim", "original_claim_id",
                              drift_type="drift_type"))
    named = edges.select(F.col("src").alias("claim_id")).union(edges.select("dst")).distinct()
    ids = claims.select("claim_id")
    if named.count() <= SMALL_LAYER:
        ids = cut_lineage(ids.join(F.broadcast(named), "claim_id", "left_semi").distinct())
    return drop_dangling(drop_dangling(edges, ids, "src"), ids, "dst")


def edges(
    chunks: DataFrame, people: DataFrame, claims: DataFrame, channels: DataFrame,
    evolution: DataFrame | None = None,
) -> DataFrame:
    episodes = chunks.select("video_id").distinct()
    parts = [
        belongs_to(chunks, channels), appeared_on(people, episodes), claim_edges(claims, episodes)]
    if evolution is not None:
        parts.append(evolved_from(evolution, claims))
    out = parts[0].select(*EDGE_COLUMNS)
    for df in parts[1:]:
        out = out.unionByName(df.select(*EDGE_COLUMNS))
    return out


def graph_counts(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    by_label = all_nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("count"))
    by_type = all_edges.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("count"))
    return by_label.select(F.lit("node").alias("part"), "kind", "count").unionByName(
        by_type.select(F.lit("edge").alias("part"), "kind", "count"))


def orphans(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """People on no episode; claims without an episode; claims without a topic."""
    def missing(check: str, label: str, kinds: list[str], side: str) -> DataFrame:
        linked = all_edges.filter(F.col("type").isin(kinds)).select(F.col(side).alias("id")).distinct()
        return all_nodes.filter(F.col("label") == label).join(linked, "id", "left_anti").agg(
            F.count("*").alias("orphans")).select(F.lit(check).alias("check_name"), "orphans")

    return (
        missing("person without episode", "Person", ["APPEARED_ON"], "src")
        .unionByName(missing("claim without episode", "Claim", ["SOURCED_FROM", "DISCUSSED_IN"], "src"))
        .unionByName(missing("claim without topic", "Claim", ["ABOUT"], "src")))


# --- questions ---------------------------------------------------------------------------

def who_discussed(claims: DataFrame, topic: str, phrase: str | None = None, k: int = 25) -> DataFrame:
    hit = icontains(F.col("topic"), topic) | icontains(F.col("claim_text"), phrase or topic)
    groups = claims.filter(F.coalesce(hit, F.lit(False))).groupBy(
        F.col("speaker").alias("person"), F.col("channel_name").alias("channel")).agg(F.count("*").alias("claims"))
    return top_k(groups, [F.desc("claims"), "person", "channel"], k)


def channel_topics(claims: DataFrame, channel: str, k: int = 25) -> DataFrame:
    groups = claims.filter(icontains(F.col("channel_name"), channel)).groupBy("topic").agg(
        F.count("*").alias("mentions"))
    return top_k(groups, [F.desc("mentions"), "topic"], k)


def most_discussed(claims: DataFrame, k: int = 25) -> DataFrame:
    groups = claims.groupBy("topic").agg(F.count("*").alias("mentions"))
    return top_k(groups, [F.desc("mentions"), "topic"], k)


def speaker_claims(claims: DataFrame, speaker: str, k: int = 25) -> DataFrame:
    rows = claims.filter(icontains(F.col("speaker"), speaker)).select(
        "topic", F.col("claim_text").alias("claim"), F.col("claim_date").alias("date"),
        F.col("channel_name").alias("channel"), "claim_id")
    return top_k(rows, [F.desc("date"), "claim_id"], k)


def most_appearing(all_edges: DataFrame, k: int = 25) -> DataFrame:
    groups = all_edges.filter("type = 'APPEARED_ON'").groupBy(F.col("src").alias("person")).agg(
        F.count("*").alias("episodes"))
    return top_k(groups, [F.desc("episodes"), "person"], k)


def person_channels(appeared: DataFrame, belongs: DataFrame) -> DataFrame:
    """Person to channel by way of the episode."""
    to_channel = belongs.select(F.col("src").alias("video_id"), F.col("dst").alias("channel"))
    return appeared.select(F.col("src").alias("person"), F.col("dst").alias("video_id")).join(
        to_channel, "video_id").select("person", "channel").distinct()


def multi_channel_people(appeared: DataFrame, belongs: DataFrame, k: int = 25) -> DataFrame:
    lists = collect_distinct(person_channels(appeared, belongs), ["person"], "channel", "channels")
    many = lists.withColumn("channel_count", F.size("channels").cast("long")).filter("channel_count > 1")
    return top_k(many, [F.desc("channel_count"), "person"], k)


def co_appearance(appeared: DataFrame, person: str) -> DataFrame:
    """Everyone who was on an episode with ``person``, with the number of shared episodes."""
    theirs = appeared.filter(F.col("src") == person).select("dst").distinct()
    return appeared.filter(F.col("src") != person).join(theirs, "dst", "left_semi").groupBy(
        F.col("src").alias("person")).agg(F.count_distinct("dst").alias("shared_episodes"))


def adjacency(all_edges: DataFrame, piece: int = 1024) -> DataFrame:
    """(a, piece, near): the neighbours of each node, direction ignored, packed into lists.

    A node with many edges has several lists of about ``piece`` neighbours, so no hub is one row.
    """
    out = all_edges.select(
        F.struct(F.col("src_label").alias("label"), F.col("src").alias("id")).alias("a"),
        F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("id")).alias("b"))
    links = cut_lineage(out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = links.groupBy("a").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / piece))
    cut = skew_join(links, degree, "a", "n").withColumn("piece", F.pmod(F.xxhash64("b"), F.col("pieces")))
    return cut.groupBy("a", "piece").agg(F.sort_array(F.collect_list("b")).alias("near"))


def k_hop(all_edges: DataFrame, label: str, start: str, k: int = 2, packed: DataFrame | None = None) -> DataFrame:
    """Nodes within ``k`` steps of a node, direction ignored, with the number of steps.

    Lists of neighbours (``packed``, as ``adjacency`` gives them) are built once. Each round joins
    only the newest layer, drops nodes seen before and is checkpointed. A layer counted as small
    is broadcast, so the lists of a hub stay where they are.
    """
    packed = cut_lineage(adjacency(all_edges)) if packed is None else packed
    spark = all_edges.sparkSession
    layer = spark.range(1).select(
        F.struct(F.lit(label).alias("label"), F.lit(start).alias("id")).alias("node"), F.lit(0).alias("hops"))
    seen = layer
    for step in range(1, k + 1):
        front = layer.select(F.col("node").alias("a"))
        if layer.count() <= SMALL_LAYER:
            front = F.broadcast(front)
        reached = packed.join(front, "a", "left_semi").select(F.explode("near").alias("node")).distinct()
        layer = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(step)))
        seen = seen.unionByName(layer)
    return seen.select("node.label", "node.id", "hops")
