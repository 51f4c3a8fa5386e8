"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tickwise import catalogue, language, protocols  # noqa: F401

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def sql():
    if not TABLES.is_dir():
        pytest.skip(f"no tables in {TABLES}")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, str(TABLES))
    want = sql.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in names]).collect())
    assert rows == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
