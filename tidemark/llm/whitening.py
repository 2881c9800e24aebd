"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import small_batches, staged
from tidemark.llm.hard_negatives import finite

EPS = float(np.finfo(float).eps)


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L (d, rank) with L @ L.T = c for a positive semidefinite c, the largest remaining diagonal entry first. Rows are c's, so L with its rows
    in the order of the pivots is lower triangular. It ends where what remains is rounding."""
    rest = np.diag(c).astype(float).copy()
    floor = len(c) * EPS * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((len(c), len(c)))
    done = np.zeros(len(c), bool)
    for k in range(len(c)):
        p = int(np.argmax(np.where(done, -np.inf, rest)))
        if rest[p] <= floor:
            return factor[:, :k]
        column = (c[:, p] - factor[:, :k] @ factor[p, :k]) / math.sqrt(rest[p])
        column[done], column[p] = 0.0, math.sqrt(rest[p])
        done[p] = True
        factor[:, k] = column
        rest -= column * column
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of factor @ factor.T: its columns are rotated by pairs until all are orthogonal, then their
    squared norms are the eigenvalues and the normalised columns the vectors. Pairs that share no column are rotated at once."""
    a = factor.copy()
    n = a.shape[1]
    seats = [*range(n), *([-1] if n % 2 else [])]
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(x, y) for x, y in zip(seats[:half], reversed(seats[half:]), strict=True) if x >= 0 <= y]
            seats = [seats[0], seats[-1], *seats[1:-1]]  # a round robin: after all rounds each pair has met
            i, j = np.array(pairs, int).reshape(-1, 2).T
            x, y = a[:, i], a[:, j]
            p, q, r = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(p * q)
            off = np.divide(np.abs(r), size, out=np.zeros_like(r), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > EPS
            i, j, x, y, p, q, r = i[turn], j[turn], x[:, turn], y[:, turn], p[turn], q[turn], r[turn]
            z = (q - p) / (2 * r)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            c = 1 / np.sqrt(1 + t * t)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if worst <= 8 * EPS:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def flat(part: pa.Array, dims: int) -> np.ndarray:
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def summed(df: DataFrame, task, *names: str) -> dict:  # noqa: ANN001
    """Sums over all tasks of the arrays that task(batches) gives, by name: each task sends one row an entry, and entries are added where they are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, found in enumerate(task(batches)):
            flat_now = np.ravel(found)
            whole = flat_now.dtype.kind == "i"
            exact, real = (flat_now, np.zeros(len(flat_now))) if whole else (np.zeros(len(flat_now), np.int64), flat_now)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat_now), k, np.int32)), pa.array(np.arange(len(flat_now), dtype=np.int32)), pa.array(exact), pa.array(real)], names=["k", "at", "exact", "real"])

    rows = df.mapInArrow(run, "k int, at int, exact long, real double").groupBy("k", "at").agg(F.sum("exact").alias("exact"), F.sum("real").alias("real")).collect()
    out = {name: {r["at"]: (r["exact"], r["real"]) for r in rows if r["k"] == k} for k, name in enumerate(names)}
    return {name: [found[i] for i in range(len(found))] for name, found in out.items()}


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component, 1 to `components`.

    Entries become whole numbers x = floor(scale * c) + shift. Each distinct x vector once is the fit list, n vectors with sums S. Each task centres its part of it,
    around the whole numbers nearest to the mean, before it multiplies; these sums are exact integers, and so is the correction by what is left of the mean, so
    the scatter is the same however the rows lie. From it the driver, which gets dims x dims numbers, takes components by pivoted Cholesky and one-sided Jacobi on the factor,
    which keeps small eigenvalues accurate. deviation is the sum of (n * x - S)^2; whitened is x - S / n on the component, over the root of its
    eigenvalue; explained its eigenvalue's share; identity_error is measured on the fit list's whitened values.

    Rows with a null vector, or an entry that is null or not finite, are dropped, and so is a vector shorter than the longest, whose missing entries count as null.
    Null and repeated ids stay; repeated vectors count once in the fit. Components without variance (fewer distinct vectors than dimensions, constant entries) can't be
    whitened and have no rows. An empty table gives an empty result. Other columns aren't read. Entries so large that a deviation doesn't fit 64 bits raise an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(finite("v", dims)).select("id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))
    small_batches(spark)
    fit = staged(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if n < 2 or dims < 1:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(dims, np.int64)
        for part in batches:
            total += flat(part.column(0), dims).sum(0)
        yield total

    sums = [s for s, _ in summed(fit, totals, "sums")["sums"]]
    middle = [round(s / n) for s in sums]
    bound = fit.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c - shift))))).first()[0] + max(abs(m - shift) for m in middle) + 1
    if bound * bound >= 1 << 53 or n * bound * bound >= 1 << 63:
        raise ValueError("entries are too far apart for exact sums of their products in 64 bits")
    step = (1 << 53) // (bound * bound)
    about = np.array(middle, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((dims, dims), np.int64)
        for part in batches:
            y = (flat(part.column(0), dims) - about).astype(float)
            for start in range(0, len(y), step):  # products of few enough rows that floating point is exact
                some = y[start : start + step]
                total += (some.T @ some).astype(np.int64)
        yield total

    scatter = np.array([s for s, _ in summed(fit, products, "products")["products"]], object).reshape(dims, dims)
    left = np.array([s - n * m for s, m in zip(sums, middle, strict=True)], object)
    covariance = ((n * scatter - np.outer(left, left)) / (n * n)).astype(float)
    values, axes = one_sided_jacobi(pivoted_cholesky(covariance))
    trace = float(np.trace(covariance))
    values, axes = values[:components], axes[:, :components]
    most, total = len(values), np.array(sums, np.int64)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((n * x - total) / n) @ axes / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        first, second = np.zeros(most), np.zeros((most, most))
        for part in batches:
            w = projected(flat(part.column(0), dims))
            first, second = first + w.sum(0), second + w.T @ w
        yield first
        yield second

    found = summed(fit, moments, "first", "second")
    mean = np.array([v for _, v in found["first"]]) / n
    spread = np.array([v for _, v in found["second"]]).reshape(most, most) / n - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(most)).max(initial=0.0))
    limit = math.isqrt((2**63 - 1) // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = flat(part.column(1), dims)
            away = n * x - total
            if len(away) and np.abs(away).max() > limit:
                deviations = [sum(int(v) ** 2 for v in row) for row in away]
            else:
                deviations = (away * away).sum(1)
            size = len(part)
            each = np.repeat(np.arange(size), most)
            numbers = np.tile(np.arange(1, most + 1, dtype=np.int32), size)
            columns = [part.column(0).take(pa.array(each)), pa.array(numbers), pa.array(np.full(size * most, n)), pa.array(deviations, pa.int64()).take(pa.array(each))]
            columns += [pa.array(np.ravel(projected(x))), pa.array(np.tile(values / trace, size)), pa.array(np.full(size * most, error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
