import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame and a DuckDB relation have the same columns and, in any order, the same rows."""

    def same(df, rel):
        cols = sorted(rel.columns)
        assert sorted(df.columns) == cols
        ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        at = [rel.columns.index(c) for c in cols]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        if ours != theirs:
            print([(a, b) for a, b in zip(ours, theirs) if a != b][:3], len(ours), len(theirs))
        return ours == theirs

    return same
