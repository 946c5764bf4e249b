"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from lodestar_market import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = catalog.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 7)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        return
    out = duck.execute(ORACLE[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-7)) for x, y in zip(g, w, strict=True))]
    assert not wrong, wrong[:3]
