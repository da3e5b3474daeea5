import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, a text without white space."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", "b", 4),
        (5, LONG, "en", "b", len(LONG)),
        (6, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (6, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (None, "a row without an id but with a few words", "en", "a", 1),
        (7, "x" * 3000, "xx", "c", 3000),
        (8, "日本語 текст é\r\nsecond line\n\nthird", "", "", 5),
        (9, "one two", "en", "a", 7),
        (10, "one two", "en", "a", 7),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
