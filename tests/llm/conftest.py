import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, SHARD int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash."""
    long = "the cat sat on a mat and then " * 4000
    rows = [
        (1, "the cat sat on the mat", "en", "a", 1, "x", 0),
        (1, "the cat sat on the mat", "en", "a", 1, "x", 0),
        (2, None, "en", "a", None, None, None),
        (3, "", None, "b", 0, "", 1),
        (None, "a text without an id", "en", None, None, None, None),
        (4, long, "en", "b", len(long), "y", 1),
        (5, long, "en", "b", len(long), "y", 1),
        (6, "the mat sat on the cat", "en", None, 2, None, 1),
        (7, " \n\t ", "en", "c", 4, None, 1),
        (8, "\x00￿ 中文 🙂 é", "en", "c", 9, None, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
