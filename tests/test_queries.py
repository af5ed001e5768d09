"""Every registered query with SQL against DuckDB on the smallest scale."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")
#: Thirty fits of K-Means; ``tests/test_segments.py`` covers them on a small table.
SLOW = {"segment_checks"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)[:19].removesuffix(" 00:00:00")
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    queries, bad = entry.queries(), []
    for name, sql in entry.oracle_sql().items():
        if name in SLOW:
            continue
        df = queries[name](spark, SF)
        r = con.sql(sql)
        if table(df.columns, df.collect()) != table(r.columns, r.fetchall()):
            bad.append(name)
    assert not bad


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
