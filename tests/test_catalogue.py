"""Each registered query of the library gives the rows of its SQL."""

import os

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert name in ORACLES
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def same_as_sql(spark, tmp_path, query, table, rows, schema):
    """Whether a query of one table gives the rows of its SQL on these rows."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    df = QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[query])
    columns = [c[0] for c in want.description]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_code_filter_of_any_key(spark, tmp_path):
    keys = [0, 5, 7, 999_999, 1_000_000, 1_000_003, 8_999_999, -1, -5, -1_234_567, 2**63 - 1, -(2**63), None]
    same_as_sql(spark, tmp_path, "code_filter", "orders", [(k,) for k in keys], "o_orderkey bigint")


def test_multipart_outcomes_at_the_limits(spark, tmp_path):
    rows = [(1, "u" * 40, "h"), (2, "u" * 41, "h"), (3, None, "h"), (4, "u", None), (5, None, None), (7, None, None)]
    for width in range(1, 10):
        for over in range(-2, 3):
            key = 10**width + 2 + over
            # By the SQL a file holds 16 bytes and twice its key's digits beside the page.
            rows.append((key, "u", "é" + "h" * (3000 + over - 16 - 2 * len(str(key)) - 2)))
    same_as_sql(spark, tmp_path, "multipart_outcomes", "pages", rows, "page_id bigint, url string, html string")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
