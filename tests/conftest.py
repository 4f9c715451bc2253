import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same(spark, oracle):
    """Whether a registered query's rows are those of its SQL."""

    def compare(query, sql):
        got = query(spark, DATA).toPandas()
        want = oracle.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        rows = [sorted(tuple(map(plain, r)) for r in f[names].astype(object).itertuples(index=False)) for f in (got, want)]
        assert rows[0] == rows[1]

    return compare
