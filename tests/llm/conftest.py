import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, size string"

LONG = " ".join(f"word{k % 977} of the long text number{k}" for k in range(9000))


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns named like results."""
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, "r", 1.0, "x"),
        (3, " \t\n \x0b\r ", "en", "s", 5, "r", 1.0, "x"),
        (None, "a text without an id, of some few words", "en", None, 3, "r", None, None),
        (4, LONG, "en", "t", len(LONG), "r", 0.0, "x"),
        (5, "same words here as there", "en", "t", 1, "r", 0.0, "x"),
        (5, "same words here as there", "en", "t", 1, "r", 0.0, "x"),
        (6, "same words here as there", "en", "u", 1, "r", 0.0, "x"),
        (7, "éè \U0001f600 中文 é Kſ", "xx", "", 1, "r", 0.0, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def texts(spark):
    """Documents from a list of texts, numbered from 0."""

    def make(*items, source="s"):
        rows = [(k, t, source) for k, t in enumerate(items)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    return make


@pytest.fixture
def sf(spark):
    def read(name, scale="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{scale}/{name}.parquet")

    return read
