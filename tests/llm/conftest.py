import pytest


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns named like added ones."""
    long = "word " * 60_000
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "   \n\t ", "en", "a", 6, "x"), (None, "some text here", None, None, None, "x"), (4, long, "en", "a", len(long), "x"),
        (5, "one two three four five six seven", "en", "a", 33, "x"), (5, "one two three four five six seven", "en", "a", 33, "x"), (6, "élève ünïcode ñandú 日本語 🙂", "fr", "b", 25, "x"),
        (7, "one two three four five six seven", "en", "a", 33, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumnsRenamed({}).selectExpr("*", "score as n_words", "score as spans", "score as kept", "score as _ls_0")
