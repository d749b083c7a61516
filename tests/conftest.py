from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows as sorted text, columns by name; whole floats as integers."""

    def cell(v) -> str:
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    names = sorted(frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame) -> None:
        a, b = spark_frame.toPandas(), duck_frame
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a) == rows_of(b)

    return check
