import pytest

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 1),
    (2, "the  quick brown\tfox jumps over the lazy dog again and again", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 0),
    (6, "one", "en", None, 3),
    (7, "one", "en", "c", 3),
    (None, "a row without an id and some words to count", "en", "c", 9),
    (8, "Étude naïve — mañana 東京 the quick brown fox jumps over the lazy dog", "fr", "d", 9),
    (9, " ".join(f"w{i % 700}" for i in range(9000)), "en", "a", 9),
    (10, " ".join(f"w{i % 700}" for i in range(8990)), "en", "a", 9),
    (11, "x" * 5000, "en", "e", 9),
    (11, "x" * 5000, "en", "e", 9),
    (12, "same same same same " * 40, "en", "e", 9),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [(*r, f"k{i}", i, "z") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
