import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    cell = lambda x: repr(list(x)) if hasattr(x, "__len__") and not isinstance(x, str | bytes | dict) else "null" if x is None or pd.isna(x) else repr(round(float(x), 6)) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
