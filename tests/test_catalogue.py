"""Every catalogue query with SQL gives the rows that DuckDB gives."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import TABLES, canonical  # noqa: E402

from quillon.plans import catalogue, coverage  # noqa: E402, F401


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), rel.columns)
