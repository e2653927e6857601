"""Every query against its DuckDB SQL on the smallest tables; those without SQL must run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from cardloom.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def shown(v):
    return None if v is None or str(v) in ("nan", "<NA>", "None", "NaT") else f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame, cols):
    return Counter(tuple(map(shown, r)) for r in frame[cols].itertuples(index=False))


@pytest.fixture(autouse=True, scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
