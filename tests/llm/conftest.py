import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, None, None, "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 3), (4, "one two", "en", "a", 7),
        (5, "one two three four", "en", "a", 18), (5, "one two three four", "en", "a", 18), (None, "one two three four", "en", "a", 18),
        (6, "ONE two\tthree\nfour É", "fr", "b", 20), (7, "x " * 60_000, "en", "b", 120_000), (8, "\x0b\x0c12 # $ %", "de", "b", 9),
        (9, "Schöne Grüße aus Köln\n" * 30, "de", "b", 660), (10, "\\### Assistant: </turn> ok", "en", "b", 26),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
