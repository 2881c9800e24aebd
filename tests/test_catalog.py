"""Each registered query against the same query in SQL, on sf0.001."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog, recordings, sensors  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = plain(tuple(r) for r in found.select(*columns).collect())
    theirs = tables.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    theirs = plain(theirs)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-5) if isinstance(y, float) else y), (a, b)
