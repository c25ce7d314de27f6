"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries become whole numbers, so that sums are exact and every row is centred without rounding: n*x - S is an
integer. Three passes over the rows add up, in tasks, the sums S, the scatter of the centred rows and the scatter
of the whitened rows; what is added is of the size of the dimensions, not of the rows. The factor is found on the
driver: a square matrix of the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import exact, matrix, usable, whole

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Partial matrices meet in so many tasks a row before the last sum.
FAN = 32
#: Largest whole number of ``deviation``, a decimal of 38 digits.
MOST_DEVIATION = 10**38 - 1


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (lower trapezoidal once its rows are taken in the order of the second result) with V = L L', of as many
    columns as V has rank. The pivot is the largest diagonal entry that is left; ties go to the first."""
    n = len(v)
    left, order, factor = v.astype(float).copy(), np.arange(n), np.zeros((n, n))
    floor = n * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(left.diagonal()[k:]))
        if left[p, p] <= floor:
            return factor[:, :k], order
        left[[k, p]], factor[[k, p]], order[[k, p]] = left[[p, k]], factor[[p, k]], order[[p, k]]
        left[:, [k, p]] = left[:, [p, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that have no column in common."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if max(a, b) < n]
        yield np.array([min(x) for x in pairs], int), np.array([max(x) for x in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated until all are orthogonal: F F' stays what it is."""
    a = factor.copy()
    close = np.finfo(float).eps * np.sqrt(max(1, a.shape[0]))
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            need = np.abs(xy) > close * np.sqrt(xx * yy)
            if need.any():
                turned = True
                p, q, x, y = p[need], q[need], x[:, need], y[:, need]
                zeta = (yy[need] - xx[need]) / (2 * xy[need])
                tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cosine = 1 / np.hypot(1, tangent)
                sine = cosine * tangent
                a[:, p], a[:, q] = cosine * x - sine * y, sine * x + cosine * y
        if not turned:
            return a
    raise RuntimeError(f"columns aren't orthogonal after {sweeps} sweeps")


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance by falling size, zeros left out, and their unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    at = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(turned)
    vectors[order] = turned[:, at] / norms[at]
    return norms[at] ** 2, vectors


def _sums(rows: DataFrame, vector: str, scale: int) -> tuple[int, list[int]]:
    """The number of rows, and for each dimension the exact sum of floor(scale * entry)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            column = batch.column(0)
            width = max(len(total), pc.max(pc.list_value_length(column)).as_py() or 0)
            x = whole(matrix(column, width), scale)
            total = np.concatenate([total, np.zeros(width - len(total), object)]) + exact(x, max(1, len(x))).sum(0).astype(object)
            n += len(x)
        sums = [Decimal(n), *(Decimal(int(t)) for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["at", "s"])

    got = {r["at"]: int(r["s"]) for r in rows.select(vector).mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return got.get(-1, 0), [got[k] for k in range(len(got) - 1)] if got else []


def _scatter(rows: DataFrame, vector: str, made: Callable[[pa.Array], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the outer product of ``made(row)`` with itself."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = made(batch.column(0))
            total += y.T @ y
        yield from told(dict(enumerate(total)), TaskContext.get().partitionId() % FAN)

    def told(totals: dict[int, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([salt] * len(totals), pa.int32()), pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["salt", "at", "parts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for salt, at, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2), width)):
                totals[salt, at] = totals.get((salt, at), 0.0) + parts
        for salt in sorted({s for s, _ in totals}):
            yield from told({at: v for (s, at), v in totals.items() if s == salt}, salt)

    shape = "salt int, at int, parts array<double>"
    parts = rows.select(vector).mapInArrow(multiply, shape).repartition("salt", "at").mapInArrow(add, shape)
    parts = parts.withColumn("salt", F.lit(0)).repartition("at").mapInArrow(add, shape)
    total = np.zeros((width, width))
    for r in parts.collect():
        total[r["at"]] += r["parts"]
    return total


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row of ``rows`` that has a usable vector, and each component.

    vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal: the sum over dimensions of (n*x - S)^2, null
    beyond 38 digits), whitened, explained (the eigenvalue's share of the variance) and identity_error: the largest
    absolute entry of the covariance of all whitened rows, as measured over them, minus the identity.

    x = floor(scale * entry) + shift. Left out are null vectors and those with null or non-finite entries. Shorter vectors
    count as filled up with zeros. Repeated rows, repeated and null ids are rows of their own. Eigenvalues of zero have no
    component: equal rows, or a single one, give none, as does an empty table. Other columns are left out.
    """
    source = rows.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    n, sums = _sums(source, "vector", scale)
    width = len(sums)
    total = np.array([s + n * shift for s in sums], object)

    def moved(column: pa.Array) -> np.ndarray:
        """n*x - S of each entry, exactly."""
        x = whole(matrix(column, width), scale) + shift
        plain = max([n * max(int(x.max(initial=0)), -int(x.min(initial=0))), *map(abs, total)]) < 1 << 62
        return n * x - total.astype(np.int64) if plain else n * x.astype(object) - total

    def centred(column: pa.Array) -> np.ndarray:
        return (moved(column) / n).astype(float)

    values, vectors, measured = np.zeros(0), np.zeros((width, 0)), 0.0
    if n and width:
        covariance = _scatter(source, "vector", centred, width) / n
        values, vectors = eigen(covariance)
        explained = values / covariance.trace()
        values, vectors = values[:components], vectors[:, :components]
        weights = vectors / np.sqrt(values)
        if len(values):
            measured = float(np.abs(_scatter(source, "vector", lambda column: centred(column) @ weights, len(values)) / n - np.eye(len(values))).max())
    kept = len(values)
    if not kept:
        return source.where("false").selectExpr("vec_id", "0 as component", "0L as n", "cast(0 as decimal(38,0)) as deviation", "0D as whitened", "0D as explained", "0D as identity_error")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = moved(batch.column(1))
            wide = max(int(own.max(initial=0)), -int(own.min(initial=0)))
            squares = ((own if wide**2 * width < 1 << 62 else own.astype(object)) ** 2).sum(1)
            squares = pa.array([Decimal(s) if s <= MOST_DEVIATION else None for s in map(int, squares)], pa.decimal128(38, 0))
            size = batch.num_rows
            each = pa.array(np.repeat(np.arange(size), kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, kept + 1), size), pa.int32()), pa.array(np.full(size * kept, n), pa.int64()), squares.take(each),
                 pa.array(((own / n).astype(float) @ weights).ravel()), pa.array(np.tile(explained[:kept], size)), pa.array(np.full(size * kept, measured))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(project, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
