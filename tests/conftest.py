from __future__ import annotations

import glob
import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    def value(x):
        return round(x, 9) + 0.0 if isinstance(x, float) else x

    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        order = sorted(df.columns)
        ours = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
        at = [relation.columns.index(c) for c in order]
        theirs = sorted((tuple(value(r[i]) for i in at) for r in relation.fetchall()), key=repr)
        assert ours == theirs

    return check
