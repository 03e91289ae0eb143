from __future__ import annotations

import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(result, expected) -> None:
    """Equal pandas frames but for the order of rows and columns."""
    cols = sorted(expected.columns)
    assert sorted(result.columns) == cols
    expected = expected.astype({c: "float64" for c in cols if str(expected[c].dtype) == "Int64"})  # integers with nulls, as toPandas() has them
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (result, expected))
    assert len(a) == len(b)
    for c in cols:
        assert a[c].dtype == b[c].dtype, (c, a[c].dtype, b[c].dtype)
        differ = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not differ.any(), (c, a[differ].head(), b[differ].head())
