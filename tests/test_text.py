import pytest
from pyspark.sql import functions as F

from talkmine.functions import text as tx


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_three_whitespace_rules(spark):
    got = values(
        spark, ["a  b ", "", " a\tb\nc ", "x y", None],
        tx.space_count(F.col("c")), tx.word_count(F.col("c")), tx.strip_ws(F.col("c")))
    assert got[0] == (4, 2, "a  b")
    assert got[1] == (1, 0, "")
    assert got[2][1:] == (3, "a\tb\nc")
    assert got[3][1] == 2
    assert got[4][1] == 0


def test_word_count_matches_python_split(spark):
    texts = ["été  　 x", "a b c", "\x1cone\x1ftwo", "plain words here", "\n\n"]
    assert [r[0] for r in values(spark, texts, tx.word_count(F.col("c")))] == [len(s.split()) for s in texts]


def test_strip_matches_python(spark):
    texts = ["  a b  ", "\x1fq\x1c", "   ", "　é　"]
    assert [r[0] for r in values(spark, texts, tx.strip_ws(F.col("c")))] == [s.strip() for s in texts]


def test_clean_text_and_flag(spark):
    got = values(
        spark, ["[MUSIC] hi &amp; bye", "[inaudible]x", "[Silence]", None, "no [music here"],
        tx.clean_text(F.col("c")), tx.is_artifact(F.col("c")))
    assert got[0] == ("hi   bye", True)
    assert got[1] == ("x", False)
    assert got[2] == ("[Silence]", False)
    assert got[3][1] is False and got[4][1] is False


def test_case_sensitive_markers(spark):
    got = values(spark, ["[MUSIC]", "[Music]"], tx.is_artifact(F.col("c"), ignore_case=False))
    assert got == [(False,), (True,)]


@pytest.mark.parametrize("iso,minutes", [
    ("PT1H30M15S", 90.25), ("PT45M", 45), ("PT30S", 0.5), ("PT2H", 120), ("P1D", 0), ("", 0), (None, 0)])
def test_iso_minutes(spark, iso, minutes):
    assert values(spark, [iso], tx.iso_minutes(F.col("c"))) == [(minutes,)]


def test_links(spark):
    assert values(spark, ["v"], tx.deep_link(F.col("c"), F.lit(3.9), "s")) == [
        ("https://www.youtube.com/watch?v=v&t=3s",)]
    assert values(spark, ["v"], tx.deep_link(F.col("c"), F.lit(3.9))) == [
        ("https://www.youtube.com/watch?v=v&t=3",)]


def test_contains_and_wildcards(spark):
    got = values(
        spark, ["a_b", "axb", "A_B"], tx.icontains(F.col("c"), "A_b"), tx.icontains(F.col("c"), "A_b", True))
    assert got == [(True, True), (False, True), (True, True)]


def test_known_speaker(spark):
    got = values(spark, [None, " unknown ", "Ann", ""], tx.known_speaker(F.col("c")))
    assert got == [(False,), (False,), (True,), (True,)]


def test_safe_timestamp(spark):
    got = values(spark, ["2024-01-02T03:04:05Z", "Unknown"], tx.safe_ts(F.col("c")).isNull())
    assert got == [(False,), (True,)]


@pytest.mark.parametrize("coverage,view,chunk", [
    (0.9, "HIGH", "HIGH"), (0.85, "MEDIUM", "HIGH"), (0.7, "MEDIUM", "MEDIUM"), (0.65, "LOW", "MEDIUM"),
    (0.64, "LOW", "LOW"), (1.05, "HIGH", "HIGH"), (None, "LOW", "LOW")])
def test_quality_tiers(spark, coverage, view, chunk):
    row = spark.createDataFrame([(coverage,)], "c double").select(
        tx.quality_tier(F.col("c"), "view"), tx.quality_tier(F.col("c"), "chunk")).first()
    assert tuple(row) == (view, chunk)


def test_strict_json_rejects_what_follows(spark):
    from pyspark.sql import types as T
    kind = T.ArrayType(T.IntegerType())
    got = values(spark, ["[1,2]", "[1] and [2]", "[1],[2]", "[1", "", None], tx.strict_json(F.col("c"), kind))
    assert got == [([1, 2],), (None,), (None,), (None,), (None,), (None,)]
