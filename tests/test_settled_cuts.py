"""Cut series see the same slices wherever they are read, though the cuts are approximate."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, sliced
from tidemark.operators.sliced import Series


@pytest.fixture
def unsteady(monkeypatch):
    """Approximate quantiles that differ each time they are computed, as those of large tables do with the order in which tasks end."""
    exact = F.percentile_approx
    moved = F.udf(lambda xs: sorted(x + random.SystemRandom().randrange(-20, 21) for x in xs), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(sliced.F, "percentile_approx", lambda x, *more: moved(exact(x, *more)))


def test_cuts_that_differ_each_time(spark, unsteady):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    own = Series(df, "k", ["t"], 100).framed(3, a=lambda w: F.sum("v").over(w.rowsBetween(-3, 0))).running(n=sliced.number(), s=sliced.total(F.col("v")))
    v = [float(i * 7 % 31) for i in range(2000)]
    assert own.is_cut
    assert sorted((r.t, r.a, r.n, r.s) for r in own.rows.collect()) == [(i, sum(v[max(0, i - 3) : i + 1]), i + 1, sum(v[: i + 1])) for i in range(2000)]


def test_forecast_with_cuts_that_differ_each_time(spark, unsteady):
    """Rows whose lags were cut off made arrays of unequal length."""
    random.seed(3)
    made = [(1, i, random.random()) for i in range(1200)]
    real, other = (spark.createDataFrame(made[k::2], "k int, t long, v double") for k in (0, 1))
    found, wanted = (sorted(map(tuple, forecast.transfer(real, other, "k", ["t"], "v", 3, 0.3, rows=most).collect())) for most in (50, 10**9))
    assert [x[:3] for x in found] == [x[:3] for x in wanted]
    assert all(a == pytest.approx(b) for x, y in zip(found, wanted, strict=True) for a, b in zip(x[3:], y[3:], strict=True))
