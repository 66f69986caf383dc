import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_ = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, long_, "en", "s", len(long_)),
        (5, long_ + " more", "en", "s", 0),
        (6, "one two", "en", "s", 7),
        (6, "one two", "en", "s", 7),
        (None, "one two", None, None, 7),
        (7, "one two", "en", "s", 7),
        (8, "ünï çödé 中文 " * 40, "xx", "s", 1),
        (8, "another text of the same id altogether", "xx", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns whose names the operators use inside."""
    rows = [(i, f"text number {i} of a small set of texts", "x", "y", 1, "a", 2, 3, 4.0, 5, 6, "z", 1, 2, 3, "s", 4, [1], [2], 5, 6, "k", 7) for i in range(6)]
    return spark.createDataFrame(rows, DOCS + ", id string, n long, label int, score double, row long, page long, hash string, cell long, bucket long, comp long, shard string, depth int, _all array<int>, _terms array<int>, _salt int, _level int, _mask string, first long")
