"""Every query of the vector-search part: against its SQL where there is one, else for its rows."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL

from vecmill import catalogue

TABLES = ("events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    if sql := catalogue.oracle_sql().get(name):
        wanted = duck.execute(sql)
        columns = [c[0] for c in wanted.description]
        assert sorted(columns) == sorted(found.columns)
        order = [found.columns.index(c) for c in columns]
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        got, want = sorted((tuple(r[i] for i in order) for r in rows), key=key), sorted(wanted.fetchall(), key=key)
        assert len(got) == len(want)
        wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        assert not wrong, (len(wrong), wrong[:3])
