import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "alpha beta gamma " * 40_000


@pytest.fixture
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "one two three four five", "en", "a", 23),
        (1, "one two three four five", "en", "a", 23),
        (1, "another text of the same id", "en", "a", 27),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "   \n\t ", "fr", None, 6),
        (None, "a text without an id", "en", "c", 20),
        (5, LONG, "en", "a", len(LONG)),
        (6, "x", "de", "a", 1),
    ]
    clash = "kept boolean, fp long, group long, rank long, shard int, term string, email string, y int, label long, key long, part int, score double"
    wide = [(*r, True, 1, 1, 1, 1, "t", "e", 1, 1, 1, 1, 0.5) for r in rows]
    return spark.createDataFrame(wide, f"{SCHEMA}, {clash}")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
