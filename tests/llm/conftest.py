import pytest

#: Null, empty, one-word and very long texts, null ids, repeated rows, and columns whose names operators use inside.
PASSAGE = " ".join(f"passage{i}" for i in range(45))
LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(30_000))
EDGE_ROWS = [
    (1, PASSAGE + " one", "en", "s0", 7, "x"), (2, None, "en", "s0", 7, None), (3, "", None, None, None, "x"),
    (4, "   \t\n", "en", "s1", 3, "x"), (None, "start " + PASSAGE, "en", None, 3, "x"), (6, LONG, "en", "s0", 3, "x"),
    (7, "Single", "en", "s1", 3, "x"), (7, "Single", "en", "s1", 3, "x"), (7, "other text with the same id", "de", "s1", 3, "y"),
    (8, PASSAGE + " " + PASSAGE, "en", "s2", 3, "x"), (9, PASSAGE + " one", "en", "s0", 3, "x"), (None, None, None, None, None, None),
    (10, LONG + " and a tail", "en", "s0", 3, "x"), (11, "ümlaut ﬂigature 𝒳 password=abcdefghijkl", "de", "s1", 3, "x"),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, rk long, size string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
