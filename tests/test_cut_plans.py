"""Queries over recordings of cut series: each step reads what is settled, so plans don't grow with every step before, and rows are those of uncut series."""

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from test_catalog import SF, plain, tables  # noqa: F401

from tidemark.operators import sliced, staging, statistics
from tidemark.plans import catalog, recordings  # noqa: F401


def leaves(df: DataFrame) -> int:
    """How often the plan reads anything."""
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


@pytest.mark.parametrize("name", ["fingerprint_distances", "phase_durations", "gate_motion"])
def test_plans_of_cut_series(spark: SparkSession, name, monkeypatch):
    """Before, the three plans read the events hundreds to thousands of times."""
    whole = plain(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(sliced, "ROWS", 60)
    most = []
    settled = staging.settled
    monkeypatch.setattr(sliced, "settled", raising=False, value=lambda df: (most.append(leaves(df)), settled(df))[1])
    found = catalog.QUERIES[name](spark, SF)
    assert max(most, default=0) <= 40 and leaves(found) <= 150
    for a, b in zip(plain(map(tuple, found.collect())), whole, strict=True):
        assert all(x == (pytest.approx(y, abs=2e-5) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True)), (a, b)


def test_otsu_tries_all_percentiles(spark, tables):  # noqa: F811
    """Few values, many equal ones and one value a key: each percentile's ranks are found."""
    rows = [(k, float(v)) for k, vs in {"a": [1] * 150 + [9] * 40, "b": range(21), "c": [i // 30 for i in range(400)], "d": [5], "e": [i * i % 97 for i in range(100)]}.items() for v in vs]
    df = spark.createDataFrame(rows, "event_type string, value double")
    found = statistics.otsu(df, "event_type", "value").select("event_type", "percentile", F.round("threshold", 6), F.round("low_mean", 5), F.round("high_mean", 5))
    con = tables.cursor()
    con.execute("CREATE TEMP TABLE few (event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO few VALUES (?, ?)", rows)
    wanted = con.execute(f"SELECT event_type, percentile, threshold, low_mean, high_mean FROM ({catalog.ORACLE_SQL['agg_otsu'].replace('events', 'few')})").fetchall()
    assert plain(map(tuple, found.collect())) == plain(wanted)
