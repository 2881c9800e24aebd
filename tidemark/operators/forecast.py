"""How well a series forecasts another: a linear forecast from lags, learnt from one series and tested on the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sliced
from tidemark.operators.sliced import Series

TABLE = "key {kind}, model string, coefficients array<double>"


def lagged(df: DataFrame, key: str, order: list[str], value: str, window: int, detrend: int | None = None, rows: int | None = None) -> DataFrame:
    """(key, i, y, lags): each row's number from 0, its value, and the array of the `window` values before it (fewer at the start). detrend: values about the centred mean of so many rows.

    Rows whose value is null aren't part of the series.
    """
    own = Series(df.where(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("y")), key, order, rows)
    if detrend:
        own = own.framed(detrend // 2, (detrend - 1) // 2, y=lambda w: F.col("y") - F.avg("y").over(w.rowsBetween(-(detrend // 2), (detrend - 1) // 2)))
    own = own.running(i=sliced.number()).framed(window, lags=lambda w: F.collect_list("y").over(w.rowsBetween(-window, -1)))
    return own.rows.select(key, (F.col("i") - 1).alias("i"), "y", "lags")


def fits(training: DataFrame, key: str, window: int, block: int = 8192) -> DataFrame:
    """(key, model, coefficients): least squares of y on 1 and the lags, for each key and model of training (key, model, i, y, lags).

    Blocks of rows add up their normal equations, about the model's mean, in tasks; the sums of a key and model are (window + 2)^2 / 2 numbers and are solved by themselves.
    """
    kind = dict(training.dtypes)[key]
    middle = training.groupBy(F.col(key).alias("_key"), F.col("model").alias("_model")).agg(F.avg("y").alias("_mean"))
    own = training.join(middle, F.col(key).eqNullSafe(F.col("_key")) & (F.col("model") == F.col("_model"))).select(key, "model", "_mean", F.floor(F.col("i") / block).alias("_block"), "y", "lags")

    def products(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        mean = part["_mean"].iloc[0]
        x = np.column_stack([np.ones(len(part)), np.stack(part["lags"].to_numpy()) - mean, part["y"].to_numpy() - mean])
        gram = (x.T @ x)[np.triu_indices(window + 2)]
        return pd.DataFrame({"key": pd.Series([names[0]] * len(gram), dtype=object), "model": names[1], "mean": mean, "at": np.arange(len(gram)), "s": gram})

    sums = own.groupBy(key, "model", "_block").applyInPandas(products, f"key {kind}, model string, mean double, at int, s double").groupBy("key", "model", "at").agg(F.sum("s").alias("s"), F.first("mean").alias("mean"))

    def solve(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((window + 2, window + 2))
        upper = np.triu_indices(window + 2)
        gram[upper[0][part["at"]], upper[1][part["at"]]] = part["s"]
        gram = np.triu(gram) + np.triu(gram, 1).T
        found = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=1e-12)[0]
        mean = part["mean"].iloc[0]
        found[0] += mean - mean * found[1:].sum()
        return pd.DataFrame({"key": pd.Series([names[0]], dtype=object), "model": [names[1]], "coefficients": [found.tolist()]})

    return sums.groupBy("key", "model").applyInPandas(solve, TABLE.format(kind=kind)).withColumnRenamed("key", key)


def predicted(coefficients: Column, lags: Column) -> Column:
    products = F.zip_with(F.slice(coefficients, 2, F.size(lags)), lags, lambda c, x: c * x)
    return F.get(coefficients, 0) + F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def transfer(real: DataFrame, synthetic: DataFrame, key: str, order: list[str], value: str, window: int = 50, train: float = 0.1, detrend: int | None = None, rows: int | None = None) -> DataFrame:
    """(key, model, n, rmse, nrmse, mae, relative): forecasts of the real series after its first `train` part, by a linear model of `window` lags.

    real: learnt from that first part; synthetic: from as many rows of the other series; lag_1: the value before, lag_window: the value `window` rows before. nrmse is by the range of
    the real series (with detrend, of what is forecast), relative by lag_1's rmse. A key whose parts are shorter than the window and a row has no row in the result.
    """
    own, other = lagged(real, key, order, value, window, detrend, rows), lagged(synthetic, key, order, value, window, detrend, rows)
    sizes = real.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), (F.max(value) - F.min(value)).cast("double").alias("_range"))
    sizes = sizes.withColumn("_train", F.greatest(F.lit(window + 1), F.floor(F.col("_n") * train))).where(F.col("_n") - F.col("_train") >= window + 1)
    at = lambda df: df.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    learn = lambda df, name: at(df).where((F.col("i") < F.col("_train")) & (F.col("i") >= window)).select(key, F.lit(name).alias("model"), "i", "y", "lags")
    models = fits(learn(own, "real").unionByName(learn(other, "synthetic")), key, window).withColumnRenamed(key, "_mkey")
    test = at(own).where(F.col("i") >= F.col("_train"))
    plain = F.array(F.struct(F.lit("lag_1").alias("model"), F.get("lags", window - 1).alias("p")), F.struct(F.lit("lag_window").alias("model"), F.get("lags", 0).alias("p")))
    tried = test.join(models, F.col(key).eqNullSafe(F.col("_mkey"))).select(key, "y", "_range", "model", predicted(F.col("coefficients"), F.col("lags")).alias("p"))
    tried = tried.unionByName(test.select(key, "y", "_range", F.inline(plain)))
    off = F.col("y") - F.col("p")
    span = F.max("y") - F.min("y") if detrend else F.first("_range")
    scores = tried.groupBy(key, "model").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), span.alias("_span"))
    base = scores.where("model = 'lag_1'").select(F.col(key).alias("_bkey"), F.col("rmse").alias("_base"))
    zero = F.lit(0.0)
    return scores.join(base, F.col(key).eqNullSafe(F.col("_bkey"))).select(key, "model", "n", "rmse", (F.col("rmse") / F.nullif(F.col("_span"), zero)).alias("nrmse"), "mae", (F.col("rmse") / F.nullif(F.col("_base"), zero)).alias("relative"))
