"""Every raster query that has SQL, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from echofield.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    exact = [c for c in columns if not pd.api.types.is_float_dtype(df[c])]
    return df[columns].sort_values(exact + [c for c in columns if c not in exact]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, tables, name):
    got, want = ordered(catalog.QUERIES[name](spark, SF).toPandas()), ordered(tables.execute(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0
