"""Every query against its SQL on the same tables."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = sorted(n for n in QUERIES if n != "pipeline" and not n.startswith("op"))


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes, bytearray)):
        return repr(x)
    if isinstance(x, (int, float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}" if abs(x) > 1e-12 else "0"
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(v)}" for k, v in sorted(x.items())) + "}"
    return "[" + ",".join(map(plain, x)) + "]"


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in at) for r in rows)


def close(a, b):
    """Equal, but for the last places of numbers."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-9)
    except ValueError:
        return False


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in OWN if n in SQL))
def test_against_sql(spark, sf, tables, name):
    got = QUERIES[name](spark, sf)
    asked = tables.execute(SQL[name])
    columns = [d[0] for d in asked.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(columns, asked.fetchall())
    assert len(mine) == len(theirs)
    odd = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(close, a, b))]
    assert not odd, odd[:3]


@pytest.mark.parametrize("name", sorted(n for n in OWN if n not in SQL))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
