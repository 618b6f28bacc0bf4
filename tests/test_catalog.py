"""Every registered query of the engine against its DuckDB equivalent, on the smallest tables."""

import math
from datetime import date, datetime

import duckdb
import pytest

from quartzite import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    return v


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    assert df.columns
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).to_arrow_table().to_pylist()
        assert not want or sorted(df.columns) == sorted(want[0])
        assert rows(got, sorted(df.columns)) == rows(want, sorted(df.columns))
