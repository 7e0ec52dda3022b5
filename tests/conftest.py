import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return con


def same_rows(spark_df, duck_df):
    """Rows of both, compared without regard to order or column order."""
    import pandas as pd

    a = spark_df.toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(duck_df.columns)
    key = lambda f: f[cols].sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True)
    a, b = key(a), key(duck_df)
    assert len(a) == len(b)
    for c in cols:
        x, y = a[c], b[c]
        both = x.isna() & y.isna()
        assert (both | (x == y)).all(), (c, pd.concat([x[~(both | (x == y))], y[~(both | (x == y))]], axis=1).head())
