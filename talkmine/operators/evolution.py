"""How claims on a topic change: pairs over time, drift types and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine import fixed_values as fixed
from talkmine.functions.ranking import skew_join, top_k
from talkmine.functions.text import icontains, known_speaker, present, strict_json, strip_ws, tokens
from talkmine.schemas import DRIFT_RESPONSE
from talkmine.session import cut_lineage

#: topics whose days may be sent to every task
FEW_TOPICS = 100_000
CLAIM_FIELDS = ["claim_id", "claim_text", "speaker", "channel_name", "claim_date"]
# Cue words for the rule-based drift type.
NEGATIONS = ["not", "no", "never", "none", "cannot", "without", "isn", "won", "don", "doesn", "didn"]
HEDGES = ["maybe", "might", "could", "perhaps", "possibly", "probably", "somewhat", "may"]
BOOSTERS = ["always", "certainly", "definitely", "clearly", "will", "must", "undoubtedly", "every"]


def evolution_id(original: Column, evolved: Column) -> Column:
    return F.sha2(F.concat(original.cast("string"), evolved.cast("string")), 256)


def eligible(claims: DataFrame, min_chars: int = 50) -> DataFrame:
    return claims.filter(
        present(F.col("topic")) & F.col("claim_date").isNotNull()
        & (F.length("claim_text") > min_chars) & known_speaker(F.col("speaker")))


def topic_pairs(
    claims: DataFrame, min_days: int = 30, max_topics: int | None = None, done: DataFrame | None = None
) -> DataFrame:
    """Earliest and latest claim of every topic that spans at least ``min_days``.

    The first and the last day of each topic are found first; they combine on the map side, so a topic
    with a third of all claims costs one row per task. Only claims of these days are compared.
    ``max_topics`` is a budget for whoever classifies the pairs: the topics with most claims among
    those whose pair is not in ``done``.
    """
    item = F.struct(*CLAIM_FIELDS)
    # Latest: highest date, then lowest id, hence the order by days before the far future.
    backwards = F.datediff(F.lit("9999-12-31").cast("date"), "claim_date")
    rows = eligible(claims)
    spans = cut_lineage(rows.groupBy("topic").agg(
        F.count("*").alias("claim_count"), F.min("claim_date").alias("_first"), F.max("claim_date").alias("_last")).filter(
        (F.datediff("_last", "_first") >= min_days) & (F.col("claim_count") >= 2)))
    rows = rows.select("topic", *CLAIM_FIELDS)
    if spans.count() <= FEW_TOPICS:
        rows = rows.join(F.broadcast(spans), "topic")
    else:
        rows = skew_join(rows, spans, "topic", "claim_count")
    ends = rows.filter(F.col("claim_date").isin(F.col("_first"), F.col("_last"))).groupBy("topic", "claim_count").agg(
        F.min_by(item, F.struct("claim_date", "claim_id")).alias("a"),
        F.min_by(item, F.struct(backwards, "claim_id")).alias("b"))
    spans = ends.withColumn(
        "time_delta_days", F.datediff(F.col("b.claim_date"), F.col("a.claim_date")).cast("long")
    )
    most = [F.desc("claim_count"), F.asc("topic")]
    pairs = describe_pairs(spans.filter(F.col("a.claim_id") != F.col("b.claim_id")))
    if done is not None:
        pairs = pairs.join(done.select("evolution_id"), "evolution_id", "left_anti")
    return pairs if max_topics is None else top_k(pairs, most, max_topics)


def describe_pairs(pairs: DataFrame) -> DataFrame:
    """Id, speaker match and context of pairs held as structs ``a`` (earlier) and ``b``."""
    a, b = F.col("a"), F.col("b")

    def folded(c: Column) -> Column:
        return F.nullif(F.lower(F.trim(c)), F.lit(""))

    optional = [c for c in ("claim_count", "similarity_score") if c in pairs.columns]
    return pairs.select(
        evolution_id(a["claim_id"], b["claim_id"]).alias("evolution_id"),
        a["claim_id"].alias("original_claim_id"), b["claim_id"].alias("evolved_claim_id"),
        F.coalesce(folded(a["speaker"]) == folded(b["speaker"]), F.lit(False)).alias("same_speaker"),
        F.datediff(b["claim_date"], a["claim_date"]).cast("long").alias("time_delta_days"),
        "topic", *optional,
        a["speaker"].alias("original_speaker"), b["speaker"].alias("evolved_speaker"),
        a["claim_date"].alias("original_date"), b["claim_date"].alias("evolved_date"),
        a["channel_name"].alias("channel_original"), b["channel_name"].alias("channel_evolved"),
        a["claim_text"].alias("original_text"), b["claim_text"].alias("evolved_text"))


def parse_drift(responses: DataFrame, raw: str = "raw", chars: int | None = None) -> DataFrame:
    """Drift type and analysis of each answer; unknown types are CONFIRMED, bad JSON is skipped.

    The analysis is kept whole unless ``chars`` limits it.
    """
    text = strip_ws(F.col(raw))
    body = F.when(text.startswith("```"), F.regexp_replace(text, r"(?m)^\s*```.*$", "")).otherwise(text)
    kept = [c for c in responses.columns if c != raw]
    found = F.col("_found")
    kind = F.upper(strip_ws(F.coalesce(found["drift_type"], F.lit(""))))
    analysis = strip_ws(F.coalesce(found["analysis"], F.lit("")))
    return responses.withColumn("_found", strict_json(body, DRIFT_RESPONSE)).filter(found.isNotNull()).select(
        *kept, F.when(kind.isin(fixed.DRIFT_TYPES), kind).otherwise("CONFIRMED").alias("drift_type"),
        (analysis if chars is None else F.left(analysis, F.lit(chars))).alias("analysis"))


def evolution_rows(pairs: DataFrame, drifts: DataFrame) -> DataFrame:
    """Rows of the evolution table: pairs whose drift is known, with the analysis."""
    score = F.col("similarity_score") if "similarity_score" in pairs.columns else F.lit(None).cast("double")
    analysis = F.col("analysis") if "analysis" in drifts.columns else F.lit(None).cast("string")
    kinds = drifts.select("evolution_id", "drift_type", analysis.alias("analysis"))
    return pairs.join(kinds, "evolution_id").select(
        "evolution_id", "original_claim_id", "evolved_claim_id", "drift_type", "same_speaker",
        "time_delta_days", score.alias("similarity_score"), "analysis", "original_speaker",
        "evolved_speaker", "topic", "original_date", "evolved_date", "channel_original",
        "channel_evolved", F.current_timestamp().cast("timestamp_ntz").alias("detected_at"))


def drift_rules(pairs: DataFrame, low_overlap: float = 0.5) -> DataFrame:
    """Drift type from wording alone.

    Negation on one side only: CONTRADICTED. More hedging or less certainty: SOFTENED; the
    opposite: ESCALATED. Same speaker with other words: REVISED. Otherwise CONFIRMED.
    """
    def cues(words: Column, listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(listed)))

    rows = pairs.withColumns({"_a": tokens(F.col("original_text")), "_b": tokens(F.col("evolved_text"))})
    a, b = F.col("_a"), F.col("_b")
    negated = (cues(a, NEGATIONS) > 0) != (cues(b, NEGATIONS) > 0)
    force = (cues(b, BOOSTERS) - cues(b, HEDGES)) - (cues(a, BOOSTERS) - cues(a, HEDGES))
    overlap = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    kind = (
        F.when(negated, "CONTRADICTED").when(force < 0, "SOFTENED").when(force > 0, "ESCALATED")
        .when(F.col("same_speaker") & (overlap < low_overlap), "REVISED").otherwise("CONFIRMED"))
    return rows.withColumns({"drift_type": kind, "overlap": F.round(overlap, 6)}).drop("_a", "_b")


def _drift_counts() -> list[Column]:
    return [F.count_if(F.col("drift_type") == d).alias(d.lower()) for d in fixed.DRIFT_TYPES]


def evolution_summary(evolution: DataFrame) -> DataFrame:
    return evolution.agg(
        F.count("*").alias("total"), F.count_distinct("topic").alias("topics"), *_drift_counts())


def drift_summary(evolution: DataFrame) -> DataFrame:
    return evolution.groupBy("drift_type").agg(
        F.count("*").alias("count"), F.round(F.avg("time_delta_days"), 4).alias("avg_days_apart"))


def cross_channel(evolution: DataFrame) -> DataFrame:
    return evolution.filter(F.col("channel_original") != F.col("channel_evolved")).groupBy(
        "channel_original", "channel_evolved", "drift_type").agg(F.count("*").alias("count"))


def most_evolved_topics(evolution: DataFrame, k: int = 20) -> DataFrame:
    kind = F.col("drift_type")
    groups = evolution.groupBy("topic").agg(
        F.count("*").alias("evolution_count"),
        F.count_if(kind == "CONTRADICTED").alias("contradictions"),
        F.count_if(kind == "CONFIRMED").alias("confirmations"))
    return top_k(groups, [F.desc("evolution_count"), "topic"], k)


def mind_changers(evolution: DataFrame, k: int = 10) -> DataFrame:
    changed = F.col("drift_type").isin("REVISED", "SOFTENED") & F.col("same_speaker")
    groups = evolution.filter("same_speaker").groupBy("original_speaker").agg(
        F.count("*").alias("total_evolutions"), F.count_if(changed).alias("changed_mind_count"))
    return top_k(groups, [F.desc("changed_mind_count"), "original_speaker"], k)


def channel_drift(evolution: DataFrame, k: int = 10) -> DataFrame:
    groups = evolution.groupBy(F.col("channel_original").alias("channel")).agg(
        F.count("*").alias("total_evolutions"), *_drift_counts())
    return top_k(groups, [F.desc("contradicted"), "channel"], k)


def most_debated(evolution: DataFrame, k: int = 10) -> DataFrame:
    """Topics by contradictions. A person on both sides of a topic counts twice."""
    groups = evolution.filter(F.col("topic").isNotNull()).groupBy("topic").agg(
        F.count("*").alias("evolution_count"),
        F.count_if(F.col("drift_type") == "CONTRADICTED").alias("contradictions"),
        (F.count_distinct("original_speaker") + F.count_distinct("evolved_speaker")).alias("speakers_involved"))
    return top_k(groups, [F.desc("contradictions"), "topic"], k)


def with_claim_texts(evolution: DataFrame, claims: DataFrame) -> DataFrame:
    """Attach text and link of both claims of each pair."""
    def side(prefix: str) -> DataFrame:
        return claims.select(
            F.col("claim_id").alias(f"{prefix}_claim_id"), F.col("claim_text").alias(f"{prefix}_text"),
            F.col("youtube_url").alias(f"{prefix}_url"))

    bare = evolution.drop("original_text", "evolved_text")
    return bare.join(side("original"), "original_claim_id").join(side("evolved"), "evolved_claim_id")


def evolution_lookup(
    evolution: DataFrame, claims: DataFrame, speaker: str | None = None, topic: str | None = None,
    drift: str | None = None, k: int = 10,
) -> DataFrame:
    """Widest pairs by speaker, else topic, else drift type, else of all."""
    rows = evolution
    if speaker:
        rows = rows.filter(
            icontains(F.col("original_speaker"), speaker) | icontains(F.col("evolved_speaker"), speaker))
    elif topic:
        rows = rows.filter(icontains(F.col("topic"), topic))
    elif drift and drift.upper() in fixed.DRIFT_TYPES:
        rows = rows.filter(F.col("drift_type") == drift.upper())
    # Both claims must exist, so the join comes before the limit.
    return top_k(with_claim_texts(rows, claims), [F.desc("time_delta_days"), "evolution_id"], k)
