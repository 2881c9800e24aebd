"""Pairs of devices by blocks against the plain join."""

import duckdb
import numpy as np
import pytest

from tidemark.operators.agreement import agreement
from tidemark.plans import catalog, sensors  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_sensor_pairs_has_all_pairs_of_a_group(spark):
    """Not neighbours alone: devices 0 and 20, 30, ... of a group of ten numbers meet too."""
    e = f"(SELECT user_id AS u, round_even(epoch_us(ts) / 1e6 / 3600, 0)::BIGINT AS t FROM '{SF}/events.parquet' GROUP BY ALL)"
    want = set(duckdb.sql(f"SELECT x.u, y.u, count(*) FROM {e} x JOIN {e} y ON x.t = y.t AND x.u < y.u AND x.u % 10 = y.u % 10 GROUP BY ALL").fetchall())
    found = {(r.a, r.b, r.n) for r in catalog.QUERIES["sensor_pairs"](spark, SF).collect()}
    assert found == want and any(b - a > 10 for a, b, _ in found)


@pytest.mark.parametrize("block, ticks", [(1000, 8192), (3, 8192), (4, 5)])
def test_blocks_and_slices(spark, block, ticks):
    """Unknown states, missing keys and groups, ids that are negative, one key's ticks over many slices."""
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(t)) for k, t in zip(rng.integers(-15, 15, 300), rng.integers(-20, 20, 300), strict=True)})
    rows = [(k % 3, k, t, [True, False, None][int(rng.integers(0, 3))]) for k, t in rows] + [(None, 50, 1, True), (0, None, 1, True), (0, 51, None, True)]
    want = {}
    for g, k, t, s in rows:
        for h, m, u, z in rows:
            if None not in (g, k, t, h, m, u) and g == h and t == u and k < m:
                n, known, same = want.get((k, m), (0, 0, 0))
                want[k, m] = n + 1, known + (None not in (s, z)), same + (s == z and s is not None)
    found = agreement(spark.createDataFrame(rows, "g long, k long, t long, s boolean"), "g", "k", "t", "s", block, ticks).collect()
    assert {(r.a, r.b): (r.n, r.agree) for r in found} == {p: (n, same / known if known else None) for p, (n, known, same) in want.items()}
    assert len(found) == len(want)


def test_no_rows(spark):
    assert agreement(spark.createDataFrame([], "g long, k long, t long, s boolean"), "g", "k", "t", "s").collect() == []
