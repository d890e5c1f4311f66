"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Vectors are put on a grid of whole numbers and each different one counts once. Tasks sum the vectors, then the products of
the centred vectors; only such sums of at most ``GROUPS`` groups of tasks meet in the driver, as large as the square of the
dimension whatever the number of rows. Pivoted Cholesky splits the covariance into a triangular factor and its transpose and
shows its rank. Rotations from the right make the factor's columns orthogonal: their squared lengths are the eigenvalues,
and divided by their lengths they are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import written

#: Places on the grid for 1, and what is added so that usual entries are positive.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond are set to it: sums stay exact and no whole number overflows.
LARGEST = 1 << 50
#: Groups of tasks whose sums the driver adds.
GROUPS = 64
#: Share of the largest variance below which what is left of one counts as rounding.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: the number and sums of the different vectors, components in columns, their eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with as many columns as v has rank and v = G G^T; its rows in pivot order are lower triangular."""
    d = len(v)
    g = np.zeros((d, d))
    left = np.diag(v).astype(float).copy()
    least = max(left.max(initial=0.0), 0.0) * d * NOTHING
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= least:
            return g[:, :k]
        g[:, k] = (v[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(left[p])
        g[:, k][left == -np.inf] = 0.0
        g[p, k] = np.sqrt(left[p])
        left -= g[:, k] ** 2
        left[p] = -np.inf
    return g


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of pairs without a common column."""
    ring = np.arange(n + n % 2)
    for _ in range(len(ring) - 1):
        a, b = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
        real = (a < n) & (b < n)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def orthogonal_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """g times rotations that leave its columns orthogonal to rounding, in falling order of their lengths."""
    g = g.copy()
    for _ in range(sweeps):
        worst = 0.0
        for i, j in _rounds(g.shape[1]):
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = np.where(turn, b - a, 0.0) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, i], g[:, j] = x * cos - y * sin, x * sin + y * cos
        if worst < 1e-15:
            break
    return g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components in columns) of a covariance, as many as its rank; each component's largest entry is positive."""
    turned = orthogonal_columns(pivoted_cholesky(v))
    size = np.sqrt((turned * turned).sum(axis=0))
    u = turned / size
    if u.size:
        u *= np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return size * size, u


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def on_grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector has the usual length and finite entries only, x = floor(64 c) + 1000000."""
    column = [c for c in ("embedding", "vector") if c in vectors.columns][0]
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            x = np.clip(np.floor(v * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET
            cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))], names=["vec_id", "x"])

    return rows.where(F.size("v") == (usual["d"] if usual else 0)).mapInArrow(run, "vec_id long, x array<long>")


def _summed(rows: DataFrame, of: str, make) -> np.ndarray:
    """The sum over all rows of ``make`` (matrix of rows -> array of numbers), added in tasks, groups of tasks and the driver."""
    kind = np.int64 if of == "long" else np.float64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                more = make(_matrix(b.column("x"))).ravel().astype(kind)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(kind)))], names=["total"])

    def group(table: pa.Table) -> pa.Table:
        total = _matrix(table.column("total").combine_chunks()).sum(axis=0)
        return pa.table({"total": pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(kind)))})

    schema = f"total array<{of}>"
    parts = rows.select("x").mapInArrow(part, schema).withColumn("place", F.spark_partition_id() % GROUPS)
    found = parts.groupBy("place").applyInArrow(lambda t: group(t), schema).collect()
    return np.sum([r["total"] for r in found], axis=0, dtype=kind) if found else np.zeros(0, dtype=kind)


def fit(grid: DataFrame, most: int = 16) -> Whitening:
    """Components of the different vectors of ``on_grid``, ``most`` at most, fewer where the covariance has a lower rank.

    The covariance is that of the vectors less their mean, divided by their number. The same vector in many rows counts once and
    meets itself before and after one shuffle. Without a row, n is 0 and there are no components.
    """
    different = written(grid.select("x").distinct(), "vectors")
    first = _summed(different, "long", lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    if not len(first):
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    n, sums = int(first[0]), [int(s) for s in first[1:]]
    # whole centres leave whole numbers, so products are exact; the rest of the mean, below one, is taken off their sum
    centre = np.array([s // n for s in sums])
    rest = np.array([s % n for s in sums]) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(float)
        return y.T @ y

    d = len(sums)
    v = _summed(different, "double", products).reshape(d, d) / n - np.outer(rest, rest)
    values, u = eigen((v + v.T) / 2)
    trace, values, u = float(np.trace(v)), values[:most], u[:, :most]
    scaled = u / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = ((x - centre) - rest) @ scaled
        return np.vstack([w.sum(axis=0), w.T @ w])

    error, k = 0.0, u.shape[1]
    if k:
        found = _summed(different, "double", moments).reshape(k + 1, k) / n
        error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())
    return Whitening(n, sums, u, values, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum of (n x - S)^2; null where it is beyond a long."""
    centre = np.array([s // n for s in sums])
    rest = [s % n for s in sums]
    y = x - centre
    top = int(np.abs(y).max(initial=0)) + 1
    if x.shape[1] * (n * top) ** 2 < 1 << 63:
        z = n * y - np.array(rest)
        return (z * z).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in y.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on each component, at unit variance.

    ``vectors`` has vec_id and embedding (or vector), numbers of any kind. Entries become whole numbers, 64 places to one; the
    different vectors of these, n, are the fit list. Components are numbered from 1 by falling eigenvalue. deviation is the exact
    squared distance of n times the vector from the fit list's sum (null where no long holds it); explained is the component's
    share of the whole variance; identity_error is how far the whitened fit list's covariance is from the identity, measured over it.

    Left out: rows whose vector is null, empty, or has null or infinite entries or NaN, and rows whose vector has another length than
    most have (of equally frequent lengths the longest counts). Entries beyond 2^44 count as 2^44. Repeated rows and ids each keep
    their rows, a null vec_id stays null. Equal eigenvalues leave their components free inside their plane. Where all
    vectors are equal, or none is left, there are no components and no rows. Other columns are ignored.
    """
    # the grid is worked out again where it is needed: that is cheaper than to keep it
    grid = on_grid(vectors)
    model = fit(grid, most)
    k = model.components.shape[1]
    n, sums = model.n, model.sums
    scaled = model.components / np.sqrt(model.eigenvalues) if k else model.components
    shares = model.eigenvalues / model.trace if k else model.eigenvalues
    error = model.identity_error
    centre, rest = np.array([s // n for s in sums] if k else []), np.array([s % n for s in sums] if k else []) / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            x = _matrix(b.column("x"))
            m = len(x)
            w = ((x - centre) - rest) @ scaled
            ids = pa.array(b.column("vec_id")).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m))
            whole = [ids, number, pa.array(np.full(m * k, n)), deviation, pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(whole, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return grid.mapInArrow(run, SCHEMA)
