"""Every core query runs on the smallest tables, and equals its SQL where there is one."""

import glob
import math
import os

import duckdb
import pytest

from quillspark.plans import registry

NAMES = list(registry.queries())


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v) if v is not None else None


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(x[names.index(c)]) for c in columns) for x in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_query_names():
    assert set(registry.oracle_sql()) <= set(NAMES)
