import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and blank texts, a very long word and text, ties, repeated rows, an
    extra column whose name operators use for themselves."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven.", "en", "a"), (1, "One two three four five six seven.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "fr", None), (None, "no id here at all, none", "en", "b"),
        (5, "x" * 20_000, "en", "b"), (6, long_text, "en", "b"), (7, "un deux trois quatre cinq six", "fr", "c"),
        (8, "un deux trois quatre cinq six", "fr", "c"), (9, "\x00\x1f é漢字 кириллица", None, "c"),
        (10, "short", "de", "d"), (11, "SHORT", "de", "d"),
    ]
    from pyspark.sql import functions as F
    return documents(spark, rows).withColumn("key", F.lit("extra")).withColumn("size", F.lit(-1))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


