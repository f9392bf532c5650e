import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def sql(data):
    """Rows of a SQL query by the second engine over the same tables."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")

    def run(text, columns):
        at = con.sql(text)
        assert sorted(at.columns) == sorted(columns)
        order = [at.columns.index(c) for c in sorted(columns)]
        return sorted(repr(tuple(r[i] for i in order)) for r in at.fetchall())

    return run


@pytest.fixture()
def same(spark, data, sql):
    def check(query, text):
        df = query(spark, data)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        assert got == sql(text, df.columns)
        return got

    return check
