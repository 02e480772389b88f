from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-"))


@pytest.fixture(scope="session")
def spark():
    from genoframe.session import local_session

    session = local_session(8, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same(spark, small):
    """Hold a query against its DuckDB equivalent over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(small):
        con.execute(f"create view {name[:-8]} as select * from '{small}/{name}'")

    def check(query, sql):
        got, want = query(spark, small).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        got, want = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert got.equals(want)

    return check
