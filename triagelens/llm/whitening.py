"""Embedding whitening: principal components of a table of vectors, and the vectors on them.

Vectors become integers, so that equal ones are equal exactly. The mean and covariance
are those of the list of distinct vectors.

* **Covariance.** One pass sums the distinct vectors as integers; a second one adds up, in
  each task, the products of the vectors after the mean has been taken off, and sends one
  matrix per task. Taking the mean off an integer vector is exact but for its fraction: the
  integer part of the mean is subtracted as an integer.
* **Eigenvectors.** The summed matrix has a row per dimension, however many vectors there
  are, and is solved in one place: Householder reflections make it tridiagonal, Sturm counts
  bisect for its leading eigenvalues, inverse iteration gives their vectors, made orthogonal
  to each other where eigenvalues are close, and the reflections carry them back.
* **Projection.** Mean and components, ``COMPONENTS`` numbers per dimension, go to every task
  and all rows are projected where they lie. A last pass over the distinct vectors measures
  the covariance of what comes out.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
take no part, nor do rows with an entry beyond ``LARGEST`` or with another number of
entries than most rows have (the larger number, if two are as frequent); repeated rows
count once in the fit and are returned each; null ids are kept; a component whose variance
is below ``NO_VARIANCE`` of the largest cannot be scaled and is left out, so a table with a
single distinct vector gives no rows, as an empty one does; a deviation that does not fit a
long is null. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import written

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000  # cancels in all that is returned
LARGEST = float(1 << 40)  # of a scaled entry
NO_VARIANCE = 1e-11
CLUSTER = 1e-3  # eigenvalues closer than this share of the largest have their vectors made orthogonal
STEPS = 4  # of inverse iteration
EPS = np.finfo(float).eps


# ------------------------------------------------------------------ one small matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    size = len(a)
    reflections = []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        v = np.zeros_like(x)
        if length > 0 and np.any(x[1:]):
            v = x.copy()
            v[0] += np.copysign(length, x[0])
            v /= np.linalg.norm(v)
            # Two-sided reflection of the rest as one update of rank two.
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ v)
            w = p - (p @ v) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(d: np.ndarray, e2: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each ``x``."""
    count = np.zeros(len(x), dtype=int)
    q = np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e2[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected to double precision."""
    around = np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))
    low, high = (d - around).min(), (d + around).max()
    scale = max(abs(low), abs(high), np.finfo(float).tiny)
    low, high = np.full(wanted, low - 2 * EPS * scale), np.full(wanted, high + 2 * EPS * scale)
    place = len(d) - 1 - np.arange(wanted)  # so many eigenvalues are smaller
    least = max(EPS * EPS * scale, np.finfo(float).tiny)
    e2 = e * e
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        below = count_below(d, e2, middle, least) <= place
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solves (T - shift) x = right by elimination with row exchanges."""
    size = len(d)
    diagonal, upper, second = d - shift, np.append(e, 0.0), np.zeros(size)
    b = right.copy()
    lower = np.append(e, 0.0)
    for i in range(size - 1):
        if abs(diagonal[i]) >= abs(lower[i]):
            pivot = diagonal[i] if abs(diagonal[i]) > least else least
            diagonal[i] = pivot
            factor = lower[i] / pivot
            diagonal[i + 1] -= factor * upper[i]
            b[i + 1] -= factor * b[i]
        else:
            factor = diagonal[i] / lower[i]
            diagonal[i], under, above = lower[i], diagonal[i + 1], upper[i]
            upper[i], second[i] = under, upper[i + 1]
            diagonal[i + 1] = above - factor * under
            upper[i + 1] = -factor * second[i]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
    x = np.zeros(size)
    for i in range(size - 1, -1, -1):
        rest = b[i] - (upper[i] * x[i + 1] if i + 1 < size else 0.0) - (second[i] * x[i + 2] if i + 2 < size else 0.0)
        x[i] = rest / (diagonal[i] if abs(diagonal[i]) > least else least)
    return x


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, in columns, by inverse iteration."""
    size = len(d)
    scale = max(np.abs(d).max(), np.abs(e).max() if len(e) else 0.0, np.finfo(float).tiny)
    least = EPS * scale
    found = np.zeros((size, len(values)))
    begin, shift = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * scale:
            begin, shift = k, None
        # Equal eigenvalues get slightly different shifts, so that their systems differ.
        shift = value if shift is None else min(value, shift - 10 * least)
        x = np.random.default_rng(k).uniform(-1, 1, size)
        for _ in range(STEPS):
            x = solve_shifted(d, e, shift, x / np.linalg.norm(x), least)
            for _ in range(2):
                x -= found[:, begin:k] @ (found[:, begin:k].T @ x)
        found[:, k] = x / np.linalg.norm(x)
    return found


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns."""
    if not np.any(matrix):
        return np.zeros(min(wanted, len(matrix))), np.eye(len(matrix))[:, :wanted]
    d, e, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(d, e, min(wanted, len(d)))
    vectors = vectors_of(d, e, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values, vectors


# --------------------------------------------------------------------------- vectors


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE > LARGEST))
    whole = table.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    frequent = whole.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = frequent.dims if frequent else 0
    return whole.where(F.size(v) == dims).select(F.col(id_col).cast("long").alias("vec_id"), scaled(v).alias("x"))


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed_products(vectors: DataFrame, transform, size: int, dims: int) -> np.ndarray:
    """Sum over all vectors of the products of ``transform(x)`` with itself.

    A task sends one matrix, as rows; rows are added up before the driver reads them.
    """
    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((size, size))
        for batch in batches:
            y = transform(matrix_of(batch.column(0), dims))
            total += y.T @ y
        rows = [pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, schema=schema)

    parts = vectors.select("x").mapInArrow(run, "i int, products array<double>")
    cells = parts.select("i", F.posexplode("products").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    out = np.zeros((size, size))
    for row in cells.toLocalIterator():
        out[row.i, row.j] = row.p
    return (out + out.T) / 2


class Whitening:
    """Mean and components of the fit list; plain arrays, sent with the tasks."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.trace = n, sums, values, trace
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]  # sums = n * whole + rest
        self.fraction = np.array([r / n for r in self.rest])
        self.scaled = vectors / np.sqrt(values) if len(values) else vectors

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums) ** 2, exactly; null where a long cannot hold it."""
        y = x - self.whole
        span = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * span * span < 1 << 63:
            z = self.n * y - np.array(self.rest, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """Components of the distinct vectors of ``rows``, and how far the covariance of what
    they give is from the identity at most."""
    distinct = written(rows.select("x").distinct(), "vectors")
    sums = distinct.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = {r.j: (int(r.s), r.n) for r in sums.collect()}  # one row per dimension
    if not found:
        return None, 0.0
    dims, n = len(found), found[0][1]
    centre = Whitening(n, [found[j][0] for j in range(dims)], np.zeros(0), np.zeros((dims, 0)), 0.0)
    covariance = summed_products(distinct, centre.centred, dims, dims) / n
    values, vectors = leading_components(covariance, components)
    kept = values > max(NO_VARIANCE * values[0], 0.0)
    model = Whitening(n, centre.sums, values[kept], vectors[:, kept], float(np.trace(covariance)))
    width = int(kept.sum())
    if not width:
        return model, 0.0
    identity = summed_products(distinct, model.project, width, dims) / n
    return model, float(np.abs(identity - np.eye(width)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` of every row, ``whitened`` an array."""
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix_of(batch.column(1), dims)
            columns = [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.array(list(model.project(x)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def components(table: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for
    each vector and component."""
    rows = usable(table)
    model, error = fit(rows, count)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return each.select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("c")].alias("explained"), F.lit(error).alias("identity_error"),
    )
