"""Every query against its SQL, on the same tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, smoke, name):
    df = entry.queries()[name](spark, smoke)
    got = df.collect()
    assert got or name == "email_groups"
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for path in glob.glob(f"{smoke}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute("SET TimeZone='UTC'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows_of(df.columns, got), rows_of(columns, want.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
