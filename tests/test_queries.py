"""Every query with SQL against DuckDB on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pytest

from bitwave.plans import catalogue

DATA = Path(os.environ.get("BITWAVE_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), sql.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
