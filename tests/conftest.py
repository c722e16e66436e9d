import os
import sys
import tempfile

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.local.dir": scratch, "spark.checkpoint.dir": f"{scratch}/checkpoint", "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    """Rows as sorted tuples, columns by name, nulls alike."""
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v  # a column of longs with a null comes as doubles

    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)
