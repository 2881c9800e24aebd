"""Cut series give the rows of uncut ones, in many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_catalog import SF, plain, tables  # noqa: F401

from tidemark.operators import lookups, sliced, statistics, windows
from tidemark.operators.sliced import Series
from tidemark.plans import catalog, recordings, sensors  # noqa: F401

#: Queries over series of few rows each; statistics of counted values take minutes at this limit and are not among them.
DEVICE_QUERIES = ["exposure_alarms", "run_progress", "as_of_backward", "quat_unwrap", "stillness_timer", "held_deviation", "gate_alarm", "gate_twa", "state_transitions"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    made = [(1 if rng.random() < 0.7 else None if rng.random() < 0.3 else int(rng.integers(2, 30)), int(rng.integers(0, 300)), i, float(rng.integers(0, 50)), None if rng.random() < 0.8 else float(i)) for i in range(1200)]
    return spark.createDataFrame(made, "k long, t long, i long, v double, m double").cache()


def windowed(rows, most):
    s = Series(rows, "k", ["t", "i"], most).framed(40, 30, a=lambda w: F.sum("v").over(w.rowsBetween(-40, 30)), b=lambda w: F.lag("v", 40).over(w), c=lambda w: F.lead("v", 30).over(w))
    s = s.running(s=sliced.total(F.col("a")), n=sliced.number(), r=sliced.remaining(F.col("v")), l=sliced.last(F.col("m")), u=sliced.upcoming(F.col("m")), h=sliced.highest(F.col("v")), f=sliced.first(F.col("m")))
    return s.with_columns(z=F.col("n") % 7).framed(1, z=lambda w: F.col("z") - F.lag("z").over(w))


def test_cut_series_give_the_same_rows(rows):
    whole = windowed(rows, 10**9)
    want = sorted(map(tuple, whole.rows.collect()), key=repr)
    assert not whole.is_cut and len(want) == 1200
    for most in (500, 9):
        cut = windowed(rows, most)
        assert cut.is_cut and cut.rows.columns == whole.rows.columns
        assert sorted(map(tuple, cut.rows.collect()), key=repr) == want


def test_one_device_with_all_rows_is_many_slices(rows):
    own = Series(rows.withColumn("k", F.lit(7)), "k", ["t", "i"], 50)
    sizes = [r["count"] for r in own.df.groupBy("k", "_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150


def test_halo_reaches_over_short_slices(spark):
    df = spark.createDataFrame([(1, i // 2, i, 1.0) for i in range(200)], "k int, t int, i int, v double")
    own = Series(df, "k", ["t", "i"], 2).framed(63, 9, a=lambda w: F.count("v").over(w.rowsBetween(-63, 9)))
    assert own.is_cut and {r.i: r.a for r in own.rows.collect()} == {i: min(i, 63) + 1 + min(199 - i, 9) for i in range(200)}


def test_null_times_and_equal_times(spark):
    df = spark.createDataFrame([(1, None, i) for i in range(20)] + [(1, 5, i) for i in range(20, 60)] + [(1, 9, 99)], "k int, t int, i int")
    own = Series(df, "k", ["t", "i"], 8).running(n=sliced.number())
    assert sorted((r.i, r.n) for r in own.rows.collect()) == [(i, i + 1) for i in range(60)] + [(99, 61)]
    assert Series(df.limit(0), "k", ["t", "i"], 8).running(n=sliced.number()).rows.count() == 0


@pytest.mark.parametrize("name", DEVICE_QUERIES)
def test_queries_on_cut_series(spark, tables, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(sliced, "ROWS", 4)
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    theirs = plain(tables.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    mine = plain(tuple(r) for r in found.select(*columns).collect())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-5) if isinstance(y, float) else y), (name, a, b)


def test_functions_take_cut_series(rows):
    samples = rows.where("m is not null").select("k", "t", "i", "m").groupBy("k", "t").agg(F.max("m").alias("x"))
    q = rows.select("k", "t", "i")
    for f in (lookups.as_of, lookups.nearest, lookups.interpolated):
        assert plain(map(tuple, f(q, samples, "k", "t", "x", rows=20).collect())) == plain(map(tuple, f(q, samples, "k", "t", "x").collect()))
    for f in (lambda n: statistics.quantiles(rows, "k", "v", {"p": 0.3}, n), lambda n: statistics.mad(rows, "k", "v", n), lambda n: windows.episodes(rows.withColumn("e", F.col("t") + 2), "k", "t", "e", 3, n)):
        assert plain(map(tuple, f(5).collect())) == plain(map(tuple, f(None).collect()))


def test_p_value_matches_the_series(spark):
    d = [0.0, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0]
    got = spark.createDataFrame([(x,) for x in d], "d double").select("d", statistics.ks_p_value(F.col("d"), F.lit(100), F.lit(150)).alias("p")).collect()
    for r in got:
        x = r.d * (100 * 150 / 250) ** 0.5
        want = 1.0 if x < 0.1 else min(1.0, 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * x * x) for k in range(1, 2000)))
        assert r.p == pytest.approx(want, abs=1e-9)
