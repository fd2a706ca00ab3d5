import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Holds a query's rows against its SQL on a test table folder."""
    import duckdb

    def same(fn, sql, sf_dir):
        con = duckdb.connect()
        for name in sorted(os.listdir(sf_dir)):
            con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
        df = fn(spark, sf_dir)
        expected = con.sql(sql)
        columns = [c[0] for c in expected.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        mine = sorted(repr([r[c] for c in order]) for r in df.collect())
        theirs = sorted(repr([r[columns.index(c)] for c in order]) for r in expected.fetchall())
        assert mine == theirs

    return same
