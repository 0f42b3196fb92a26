"""Prompt tables, parsing and cleaning of model answers, and canned questions over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmine import fixed_values as fixed
from talkmine.functions.ranking import count_by_case, share_of_total, top_k
from talkmine.functions.text import (
    icontains, known_speaker, let, present, ratio, strict_json, strip_ws, unfence,
)
from talkmine.schemas import CLAIM_RESPONSE, ENTITY_RESPONSE


# --- prompts -----------------------------------------------------------------------------

INSTRUCTIONS = {
    "topics": "List three to five specific topics of this transcript as a JSON array of short strings.",
    "entities": "Name the people, organizations and technologies in this transcript as a JSON object "
                "with the arrays people, organizations and technologies.",
    "summary": "Summarise this episode in two or three sentences.",
    "claims": "List the claims in this transcript as a JSON array of objects with the keys claim_text, "
              "speaker_name, speaker_role, attribution_confidence, claim_type, topic and sentiment.",
}
# Characters of text that fit a prompt.
CLAIM_CHARS = {"claim_text": 1000, "speaker": 200, "topic": 100}
PROMPT_CHARS = {"topics": 1500, "entities": 1500, "summary": 3000, "claims": 2000}


def build_prompts(
    df: DataFrame, kind: str, key: str = "chunk_id", text: str = "chunk_text",
    context: list[str] = (), chars: int | None = None, instruction: str | None = None,
) -> DataFrame:
    """Prompts for each row: instruction, context lines, and a part of the text.

    A text longer than the prompt size goes into several prompts (``part`` of ``parts``, from 1),
    cut at blanks where there are any, that show all of it together.
    """
    limit = PROMPT_CHARS[kind] if chars is None else chars
    whole = strip_ws(F.coalesce(text, F.lit("")))
    pieces = F.regexp_extract_all(whole, F.lit(rf"(?s)\S.{{0,{limit - 1}}}(?=\s|$)|\S{{1,{limit}}}"), F.lit(0))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    lines = [F.lit(instruction or INSTRUCTIONS[kind])]
    lines += [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))) for c in context]
    lines.append(F.concat(F.lit("text: "), F.col("_piece")))
    cut = df.withColumn("_pieces", pieces).select(
        "*", F.size("_pieces").alias("parts"), F.posexplode("_pieces").alias("_pos", "_piece"))
    return cut.select(key, F.lit(kind).alias("kind"), (F.col("_pos") + 1).alias("part"), "parts",
                      F.concat_ws("\n", *lines).alias("prompt"))


# --- answers -----------------------------------------------------------------------------

def parse_claims(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per claim object in the answer; text around the array and bad JSON give none."""
    array = F.regexp_extract(unfence(F.col(raw)), r"(?s)\[.*\]", 0)
    claims = strict_json(array, CLAIM_RESPONSE)
    kept = [c for c in responses.columns if c != raw]
    return responses.select(*kept, F.posexplode(claims).alias("claim_pos", "c")).select(
        *kept, "claim_pos", "c.*")


def _domain(c: Column, allowed: list[str], default: str, fold=F.upper) -> Column:
    folded = fold(F.coalesce(c, F.lit(default)))
    return F.when(folded.isin(allowed), folded).otherwise(default)


def sanitize_claims(
    claims: DataFrame, min_chars: int = 10, reset_unknown: bool = True, model: str = "unspecified",
    chars: dict[str, int] | None = None,
) -> DataFrame:
    """Valid values and a repeatable id for each parsed claim.

    The id hashes chunk and text, so a re-run task writes the same row again. A text that an
    answer repeats is one claim: the one named first. ``chars`` limits claim_text, topic and
    speaker; nothing is cut without it. ``CLAIM_CHARS`` has the limits of the claims table.
    """
    def limited(name: str, c: Column) -> Column:
        return F.left(c, F.lit(chars[name])) if chars and name in chars else c

    text = strip_ws(F.coalesce("claim_text", F.lit("")))
    speaker = strip_ws(F.coalesce("speaker_name", F.lit("Unknown")))
    unknown = (speaker == "") | (F.lower(speaker) == "unknown")
    role = _domain(F.col("speaker_role"), fixed.ROLES, "UNKNOWN")
    confidence = _domain(F.col("attribution_confidence"), fixed.CONFIDENCES, "UNKNOWN")
    if reset_unknown:
        role = F.when(unknown, "UNKNOWN").otherwise(role)
        confidence = F.when(unknown, "UNKNOWN").otherwise(confidence)
    optional = [c for c in ("video_id", "channel_name", "youtube_url") if c in claims.columns]
    dated = [F.col("publish_date").try_cast("date").alias("claim_date")] if "publish_date" in claims.columns else []
    long_enough = claims.filter(F.length(text) >= min_chars)
    if "claim_pos" in claims.columns:
        rest = [c for c in claims.columns if c != "chunk_id"]
        first = F.min_by(F.struct(*rest), F.struct("claim_pos", F.to_json(F.struct(*rest)))).alias("c")
        long_enough = long_enough.withColumn("_text", text).groupBy("chunk_id", "_text").agg(first).select(
            "chunk_id", "c.*")
    return long_enough.select(
        F.sha2(F.concat("chunk_id", text), 256).alias("claim_id"), "chunk_id", *optional,
        limited("claim_text", text).alias("claim_text"),
        limited("topic", strip_ws(F.coalesce("topic", F.lit("General")))).alias("topic"),
        _domain(F.col("claim_type"), fixed.CLAIM_TYPES, "OPINION").alias("claim_type"),
        _domain(F.col("sentiment"), fixed.SENTIMENTS, "neutral", F.lower).alias("sentiment"),
        limited("speaker", F.when(unknown, "Unknown").otherwise(speaker)).alias("speaker"),
        role.alias("speaker_role"), confidence.alias("attribution_confidence"),
        F.lit("LLM_INFERRED").alias("attribution_source"), *dated,
        F.lit(model).alias("extraction_model"),
        F.lit("PENDING").alias("verification_status"))


def parse_topics(responses: DataFrame, raw: str = "topics_raw") -> DataFrame:
    """One row per topic of the JSON array in the answer."""
    array = F.regexp_extract(unfence(F.col(raw)), r"(?s)\[.*\]", 0)
    kept = [c for c in responses.columns if c != raw]
    rows = responses.select(*kept, F.explode(strict_json(array, T.ArrayType(T.StringType()))).alias("topic"))
    return rows.withColumn("topic", F.trim("topic")).filter(present(F.col("topic")))


def parse_entities(responses: DataFrame, raw: str = "entities_raw") -> DataFrame:
    """One row per named person, organization or technology in the answer."""
    body = F.regexp_extract(unfence(F.col(raw)), r"(?s)\{.*\}", 0)
    found = strict_json(body, ENTITY_RESPONSE)
    kept = [c for c in responses.columns if c != raw]
    kinds = {"people": "PERSON", "organizations": "ORGANIZATION", "technologies": "TECHNOLOGY"}

    def labelled(names: Column, kind: str) -> Column:
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.struct(F.lit(kind).alias("entity_type"), F.trim(n).alias("entity")))

    listed = let(found, lambda f: F.flatten(F.array(*[labelled(f[field], kind) for field, kind in kinds.items()])))
    return responses.select(*kept, F.explode(listed).alias("e")).select(*kept, "e.*").filter(
        present(F.col("entity")))


# --- work lists --------------------------------------------------------------------------

def unprocessed(src: DataFrame, done: DataFrame, key: str, limit: int | None = None,
                order: list[str] = ("video_id", "chunk_start_sec", "chunk_id")) -> DataFrame:
    """Rows whose key has not been handled. A NULL key among the handled ones hides nothing."""
    todo = src.join(done.select(key), key, "left_anti")
    return todo if limit is None else todo.orderBy(*order).limit(limit)


def pending_by_channel(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return unprocessed(chunks, done, "chunk_id").groupBy("channel_name").agg(
        F.count("*").alias("pending"))


def spread_jobs(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Spread slow work per chunk over tasks by chunk, so no channel becomes one long task.

    The number of tasks is fixed; rows this small would otherwise be merged into few.
    """
    tasks = tasks or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(tasks, "chunk_id")


# --- canned questions --------------------------------------------------------------------

def top_topics(claims: DataFrame, k: int = 15, speaker: str | None = None) -> DataFrame:
    rows = claims.filter(present(F.col("topic")))
    if speaker:
        rows = rows.filter(icontains(F.col("speaker"), speaker))
    groups = rows.groupBy("topic").agg(
        F.count("*").alias("claim_count"), F.count_distinct("speaker").alias("speaker_count"),
        F.count_distinct("channel_name").alias("channel_count"))
    return top_k(groups, [F.desc("claim_count"), "topic"], k)


def channel_report(claims: DataFrame, keyword: str) -> DataFrame:
    return claims.filter(icontains(F.col("channel_name"), keyword)).groupBy("claim_type").agg(
        F.count("*").alias("cnt"), F.count_distinct("speaker").alias("speakers"),
        F.count_distinct("topic").alias("topics"))


def top_speakers(claims: DataFrame, k: int = 15) -> DataFrame:
    kind = F.col("claim_type")
    groups = claims.filter(known_speaker(F.col("speaker"))).groupBy("speaker").agg(
        F.count("*").alias("claim_count"), F.count_distinct("topic").alias("topic_count"),
        F.count_if(kind == "PREDICTION").alias("predictions"),
        F.count_if(kind == "STATISTICAL").alias("stats"))
    return top_k(groups, [F.desc("claim_count"), "speaker"], k)


def compare(
    claims: DataFrame, a: str, b: str, topic: str | None = None, by: str = "speaker", k: int = 15
) -> DataFrame:
    """Newest claims of two speakers or two channels, side by side."""
    who = F.col({"speaker": "speaker", "channel": "channel_name"}[by])

    def side(entity: str, label: str) -> DataFrame:
        rows = claims.filter(icontains(who, entity) & (F.length("claim_text") > 30))
        if topic:
            rows = rows.filter(icontains(F.col("topic"), topic))
        return top_k(rows, [F.desc("claim_date"), "claim_id"], k).withColumn("side", F.lit(label))

    columns = ["side", "claim_id", "claim_text", "claim_type", "topic", "claim_date", "youtube_url",
               "channel_name", "speaker"]
    return side(a, "a").unionByName(side(b, "b")).select(*columns)


def recommend(
    chunks: DataFrame, claims: DataFrame, guest: str | None = None, channel: str | None = None,
    topic: str | None = None, grain: str = "chunk", k: int = 10,
) -> DataFrame:
    """Episodes (or chunks) by guest, else channel, else topic, else the most recent ones."""
    keys = ["episode_title", "channel_name", "publish_date"]
    link = "youtube_url" if grain == "chunk" else "video_id"
    titled = chunks.filter(F.col("episode_title").isNotNull())
    by_claim = guest or (topic and not channel)
    if by_claim:
        field = F.col("speaker") if guest else F.col("topic")
        hits = claims.filter(icontains(field, guest or topic)).groupBy("chunk_id").agg(
            F.count("*").alias("_claims"))
        rows, weight = titled.join(hits, "chunk_id"), F.sum("_claims")
        order = [F.desc("chunk_count"), F.asc(link)]
    else:
        rows = titled.filter(icontains(F.col("channel_name"), channel)) if channel else titled
        weight = F.count("*")
        order = [F.desc("publish_date"), F.asc(link)]
    return top_k(rows.groupBy(*keys, link).agg(weight.alias("chunk_count")), order, k)


def claim_type_share(claims: DataFrame) -> DataFrame:
    return share_of_total(claims, "claim_type")


def value_counts(claims: DataFrame, column: str) -> DataFrame:
    return claims.groupBy(column).agg(F.count("*").alias("count"))


def factcheck_queue(claims: DataFrame) -> DataFrame:
    return claims.filter(
        F.col("claim_type").isin("VERIFIABLE_FACT", "STATISTICAL")
        & (F.col("verification_status") == "PENDING"))


def claims_per_channel(claims: DataFrame) -> DataFrame:
    return claims.groupBy("channel_name").agg(
        F.count("*").alias("claim_count"), F.count_distinct("video_id").alias("episode_count"),
    ).withColumn("avg_claims_per_episode", F.round(
        ratio(F.col("claim_count") * F.lit(1.0), F.col("episode_count")), 1))


def claim_summary(claims: DataFrame) -> DataFrame:
    kind, confidence = F.col("claim_type"), F.col("attribution_confidence")
    return claims.agg(
        F.count("*").alias("total_claims"),
        F.count_distinct("video_id").alias("episodes_covered"),
        F.count_distinct("chunk_id").alias("chunks_covered"),
        F.count_if(kind == "VERIFIABLE_FACT").alias("verifiable"),
        F.count_if(kind == "PREDICTION").alias("predictions"),
        F.count_if(kind == "OPINION").alias("opinions"),
        F.count_if(kind == "STATISTICAL").alias("statistical"),
        F.count_if(confidence == "HIGH").alias("high_conf"),
        F.count_if(confidence == "MEDIUM").alias("med_conf"),
        F.count_if(F.col("speaker") != "Unknown").alias("attributed_claims"))


def credibility(claims: DataFrame) -> DataFrame:
    """Percent verified, outdated and false among the claims of each channel that were checked."""
    status = F.col("verification_status")
    counts = count_by_case(
        claims.filter(status != "PENDING"), ["channel_name"], "verification_status",
        {s: s.lower() for s in fixed.STATUSES if s != "PENDING"})
    return counts.select(
        "channel_name", F.col("total").alias("checked"),
        *[F.round(F.col(s) * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0)), 2).alias(f"{s}_pct")
          for s in ("verified", "outdated", "false")])


def topic_channel_heatmap(claims: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Claims per topic and channel in long form, or one column per named channel."""
    rows = claims.filter(present(F.col("topic")))
    if channels is None:
        return rows.groupBy("topic", "channel_name").agg(F.count("*").alias("claims"))
    return rows.groupBy("topic").pivot("channel_name", channels).agg(F.count(F.lit(1))).na.fill(0)


def date_span(episodes: DataFrame, date: str = "claim_date") -> DataFrame:
    """First and last date per channel and the months between them."""
    return episodes.groupBy("channel_name").agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count("*").alias("episodes"),
    ).withColumn("months", F.round(F.months_between("last_date", "first_date"), 2))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Overwrite the status of claims that have a verdict; the latest verdict counts."""
    columns = ["verification_status", "verification_source", "last_verified", "evidence_summary", "evidence_urls"]
    have = [c for c in columns if c in verdicts.columns]
    latest = verdicts.groupBy("claim_id").agg(
        F.max_by(F.struct(*have), F.struct("last_verified", "verification_status")).alias("v"))
    rest = [c for c in claims.columns if c not in columns]
    merged = claims.join(latest, "claim_id", "left")
    return merged.select(*rest, *[
        F.coalesce(F.col("v")[c], F.col(c)).alias(c) if c in claims.columns else F.col("v")[c].alias(c)
        for c in have])


def episode_detail(
    video_id: str, summaries: DataFrame, claims: DataFrame, participants: DataFrame
) -> DataFrame:
    """Everything about one episode as rows of (section, position key, text, detail)."""
    one = F.col("video_id") == video_id

    def part(df: DataFrame, section: str, key: str, text: str, detail: str) -> DataFrame:
        return df.filter(one).select(
            F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
            F.col(text).alias("text"), F.col(detail).cast("string").alias("detail"))

    return (
        part(summaries, "summary", "video_id", "episode_summary", "episode_title")
        .unionByName(part(claims, "claim", "claim_id", "claim_text", "verification_status"))
        .unionByName(part(participants, "participant", "participant_name", "participant_name", "participant_role")))


def search_stats(history: DataFrame) -> DataFrame:
    """Volume, last use and 95th percentile latency per kind of search.

    The percentile is read off a histogram of latencies, so no group of raw values is held.
    """
    from pyspark.sql.window import Window
    bins = history.groupBy("query_type", "latency_ms").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last"))
    kind = Window.partitionBy("query_type")
    upto = kind.orderBy("latency_ms")
    ranked = bins.withColumns({"seen": F.sum("n").over(upto), "total": F.sum("n").over(kind)})
    return ranked.groupBy("query_type").agg(
        F.sum("n").alias("searches"), F.max("last").alias("last_search"),
        F.min(F.when(F.col("seen") >= F.col("total") * 0.95, F.col("latency_ms"))).alias("p95_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"))


def recent_searches(history: DataFrame, k: int = 20) -> DataFrame:
    return top_k(history, [F.desc("created_at"), F.desc("search_id")], k)
