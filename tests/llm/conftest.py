import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, ids string, part string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    rows = [
        (1, None, None, None, None, "a", "b", "c", "d"),
        (2, "", "en", "s", 0, None, None, None, None),
        (None, "a text without an id that has some words to it", None, "s", 3, "n", "i", "p", "l"),
        (None, "a text without an id that has some words to it", None, "s", 3, "n", "i", "p", "l"),
        (3, "same words in this text as in that text", "en", "s", 39, "n", "i", "p", "l"),
        (4, "same words in this text as in that text", "en", "s", 39, "n", "i", "p", "l"),
        (4, "same words in this text as in that text", "en", "s", 39, "n", "i", "p", "l"),
        (5, long, "en", "s", len(long), "n", "i", "p", "l"),
        (6, "x" * 60000, "en", "s", 60000, "n", "i", "p", "l"),
        (7, 'mail bob.smith@mail.example.com token = "abcdef0123456789abcdef0123456789" <|endoftext|> é😀', "en", "s", 90, "n", "i", "p", "l"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
