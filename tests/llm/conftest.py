import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use themselves.
    "score double, found string, found_0 string, id string, `key` string, component string, node string, place int, n_words int"
)


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), None, "f", "g", "x", "k", "c", "n", 1, 2) for i, t in enumerate(texts)]


AWKWARD = [
    None,
    "",
    " \t\n ",
    "one",
    "one two three four",
    "one two three four five",
    "ONE two\tthree four five",
    "word " * 30_000,
    "x" * 50_000,
    "日本語 🎉 ▁ \x00 é",
    'token = "abcdefgh1234"',
    "one two three four five",
]


@pytest.fixture
def table(spark):
    """A documents table of the given texts, with extra columns whose names clash."""
    return lambda texts, first=0: spark.createDataFrame(rows_of(texts, first), SCHEMA)


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rows = rows_of(AWKWARD)
    rows += [rows[3], rows[5], (None,) * 14, (None, "one two three four five", None, None, None, *(None,) * 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
