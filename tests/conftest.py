import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        path = f"{small}/{f}" + ("/*.parquet" if os.path.isdir(f"{small}/{f}") else "")
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def same(got, want):
    """A Spark frame and a DuckDB relation with equal rows whatever their order, columns by name."""
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    left = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    right = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert left == right
