import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(prefix: str, n: int) -> str:
    return " ".join(f"{prefix}{i}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


#: Nulls in every column, empty and blank texts, repeated rows and ids, copies, a very long text, odd spaces.
ODD = [
    (1, words("a", 80), "en", "s", 1), (2, words("a", 80), "en", "s", 1), (2, words("a", 80), "en", "s", 1), (3, words("a", 79) + " z", None, None, None),
    (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \t\r\n\x0b\x0c ", "en", None, 7), (None, words("a", 80), "en", "s", 1), (None, None, None, None, None),
    (7, words("long", 30000), "en", "t", 1), (8, "one", "en", "t", 3), (9, "ONE", "de", "t", 3), (10, "x y z ▁ <|endoftext|>\n\nx", "fr", "t", 9), (11, "\U0001f600 " * 60, "en", "t", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns named like the operators' own."""
    rows = [(*r, "extra", 1, True, b"x", "h", 5) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", id string, n int, kept boolean, payload binary, host string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
