"""One Spark session for all tests."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A data frame of rows with a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def same_as_sql(spark, query, sql, sf_dir=SMALL):
    """Compares a query's rows with DuckDB's, whatever their order; doubles to 6 places."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want, got = con.execute(sql).df(), query(spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)

    def rows(df):
        def plain(v):
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                return "null"
            if isinstance(v, bool) or type(v).__name__ == "bool":
                return str(bool(v))
            if hasattr(v, "isoformat"):
                return str(pd.Timestamp(v))
            return repr(round(float(v), 6)) if not isinstance(v, str) else v

        return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
