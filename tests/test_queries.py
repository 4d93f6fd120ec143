"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from civicmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        return plain(bool(value)) if type(value).__name__ in ("bool", "bool_") else f"{float(value):.9g}"
    return pd.Timestamp(value).isoformat() if hasattr(value, "isoformat") else str(value)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
