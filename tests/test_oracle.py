"""Every query with SQL against DuckDB at the smallest size, and the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from siltstone.plans import registry
from tests.conftest import SMALL

NAMES = sorted(registry.queries())
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SMALL)
    rows = df.collect()
    if name not in SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    r = con.sql(SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    want = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
    key = lambda x: tuple(plain(x[c]) for c in sorted(df.columns))
    assert sorted(map(repr, (key(x.asDict()) for x in rows))) == sorted(map(repr, map(key, want)))


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(NAMES) <= set(e.queries())
