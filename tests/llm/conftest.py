import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: nulls in any column, empty and blank texts, repeated rows and ids, a long text, columns
#: with names that operators use themselves
HARD_ROWS = [
    (1, "Alpha beta gamma delta epsilon", "en", "a", 9, "x", True),
    (2, "Alpha beta gamma delta epsilon", "en", "b", 9, "x", True),
    (2, "Alpha beta gamma delta epsilon", "en", "b", 9, "x", True),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "", False),
    (5, " \t\n ", "de", None, 4, "x", None),
    (6, "Alphabeta gamma\tdelta epsilon", "en", "a", 9, "x", True),
    (None, "ein ganz anderer Text über Bäume", "de", "c", 9, "x", True),
    (7, "lang " * 30_000, "de", "a", 150_000, "x", True),
    (8, "12345 67890 !!!", "en", "a", 15, "x", True),
    (9, "🙂 한국어 텍스트 é", "ko", "c", 9, "x", True),
    (9, "same id, another text", "en", "c", 9, "x", True),
]
HARD_SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "keep_id string, kept boolean"
)


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD_ROWS, HARD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], HARD_SCHEMA)
