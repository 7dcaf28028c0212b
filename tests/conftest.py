import os
import sys
import tempfile

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-tidemark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same_rows(a, b):
    """Whether two pandas frames have equal rows in any order, floats to six places."""
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            v = round(float(v), 6)
            return int(v) if v == int(v) else v
        return v.item() if hasattr(v, "item") else v

    rows = [sorted((repr([plain(v) for v in r]) for r in x[sorted(x.columns)].itertuples(index=False))) for x in (a, b)]
    assert rows[0] == rows[1]
