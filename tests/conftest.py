import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted((tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


def same(df, con, sql):
    """A Spark result against DuckDB's, columns by name, rows in any order."""
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    names = sorted(df.columns)
    left = _rows([r[c] for c in names] for r in df.collect())
    at = [got.columns.index(c) for c in names]
    right = _rows([r[i] for i in at] for r in got.fetchall())
    assert left == right
