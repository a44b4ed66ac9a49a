import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    body = "The quick brown fox jumps over the lazy dog and runs away from all of the other foxes."
    rows = [
        (1, body, "en", "a", len(body), "x", 1.0), (2, body, "en", "a", len(body), "x", 1.0),
        (2, body, "en", "a", len(body), "x", 1.0), (3, "", "en", "b", 0, None, None), (4, None, None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG), "x", 2.0), (6, " \t\n ", "de", "b", 4, "x", 0.0), (7, "Wörter 漢字 don't!! it's 12", "de", "c", 9, "x", 0.0),
        (None, "a text without any id but with words", "en", "c", 3, "x", 0.0), (8, body + " Truly.", "en", "", 1, "x", 0.0),
        (7, "Wörter 漢字 don't!! it's 12", "de", "c", 9, "x", 0.0), (9, "one", "en", "a", 3, "x", 0.0),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"
    ).selectExpr("*", "'y' as raw", "2 as ids", "lang as root", "7 as mix_key")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")
