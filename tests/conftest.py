import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from colmatch.plans.shared import reach_workers

    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", "/tmp/colmatch-test-warehouse").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    reach_workers(s)
    yield s


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a query with its SQL on the smallest data."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()

    def compare(name: str) -> None:
        df = queries[name](spark, DATA)
        cols = sorted(df.columns)
        theirs = con.sql(sql[name])
        assert sorted(theirs.columns) == cols
        want = sorted(map(repr, con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + " FROM theirs").fetchall()))
        got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
        assert got == want

    return compare
