import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({(glob.glob(path + '/*.parquet') if os.path.isdir(path) else [path])!r})")
    return con


def same(got, want):
    """Whether two row lists of dicts agree, whatever their order."""
    key = lambda r: tuple(sorted((k, f"{v:.9g}" if isinstance(v, float) else str(v)) for k, v in r.items()))
    return sorted(map(key, got)) == sorted(map(key, want))


@pytest.fixture
def agree(spark, duck):
    def run(query, sql):
        got = [r.asDict() for r in query(spark, SF).collect()]
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert same(got, [dict(zip(names, r, strict=True)) for r in found.fetchall()])

    return run
