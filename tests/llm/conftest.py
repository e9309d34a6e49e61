import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _row int, repeats string, pii_spans int, hash double"
LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))


def document(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), "own", 7, "mine", 9, 0.5)


EDGES = [
    document(1, None), document(2, ""), document(3, "   \n\t "), document(4, "a"), document(5, LONG), document(6, LONG), document(7, "y" * 200_000),
    document(8, "one two three four five six"), document(8, "one two three four five six"), document(9, "12 34 !!"),
    document(None, "no id here but some words of text"), document(None, None, None), document(10, "ünï cödé 日本語 \U0001F600 text", None),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like working columns."""
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
