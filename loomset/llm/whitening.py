"""Whitening of vectors: a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast matrix.

1. Distinct vectors are the fit list. Tasks add up its vectors exactly, then, once the mean is known, the products
   of the centred ones; only those sums (a matrix of the vectors' length) reach the driver.
2. The driver rotates the covariance, pair by pair in a fixed cycle, until every entry off the diagonal is
   negligible beside the two it belongs to. That bound is relative, so small eigenvalues come out as accurate as
   large ones.
3. The largest components, divided by the roots of their eigenvalues, go to the tasks, which project each row.

Rows whose vector is null or holds null, NaN or infinite entries are left out. Shorter vectors are read as ending
in zeros. Repeated rows are all returned, and count once in the fit. Components without spread (one distinct
vector, or a constant direction) have a null `whitened`; `deviation` is null where it doesn't fit a long. An empty
table gives no rows. Columns other than the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import discard, written
from loomset.llm.embeddings import SCALE, matrix, padded, whole

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Sweeps over all pairs after which rotation ends at the latest; a few are enough.
MOST_SWEEPS = 60
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: vectors counted, exact sums by dimension, eigenvalues and unit eigenvectors (rows) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def projection(self, components: int) -> np.ndarray:
        """Rows that whiten a centred vector; not a number where a component has no spread."""
        e = self.values[:components]
        spread = e > len(self.values) * _EPS * max(self.trace, 0.0)
        return self.vectors[:components] / np.sqrt(np.where(spread, e, np.nan))[:, None]


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, by cyclic Jacobi rotations."""
    a = np.array(symmetric, np.float64)
    d = len(a)
    v = np.eye(d)  # rows: the basis so far
    negligible = _EPS * _EPS * float(np.abs(np.diag(a)).sum())
    for _ in range(MOST_SWEEPS):
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= max(_EPS * np.sqrt(abs(a[p, p] * a[q, q])), negligible):
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = row_p, row_q
                a[:, p], a[:, q] = row_p, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[order]


def sums_of(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            x = matrix(b.column(0), width)
            n += len(x)
            small = len(x) and max(abs(int(x.min())), abs(int(x.max()))) < 1 << 40
            total += (x if small else x.astype(object)).sum(axis=0).astype(object) if len(x) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())], ["i", "total", "n"])

    rows = vectors.select("x").mapInArrow(add, "i int, total decimal(38,0), n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    total = {r["i"]: int(r["total"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [total.get(i, 0) for i in range(width)]


def scatter(vectors: DataFrame, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The sum of outer products of the centred vectors, or of what `project` makes of them."""
    width = len(mean)
    size = width if project is None else len(project)
    upper = np.triu_indices(size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = matrix(b.column(0), width) - mean
            y = y if project is None else y @ project.T
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["cell", "total"])

    cells = vectors.select("x").mapInArrow(multiply, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((size, size))
    for r in cells:
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[i, j] = out[j, i] = r["total"]
    return out


def fit(vectors: DataFrame, width: int) -> Whitening:
    """The whitening of distinct vectors x of one length."""
    n, sums = sums_of(vectors, width)
    if not n or not width:
        return Whitening(n, sums, np.zeros(width), np.eye(width), 0.0)
    cov = scatter(vectors, np.array([s / n for s in sums])) / n
    values, components = jacobi(cov)
    return Whitening(n, sums, values, components, float(np.trace(cov)))


def identity_error(vectors: DataFrame, found: Whitening, components: int) -> float | None:
    """The largest entry, by size, of the whitened vectors' covariance less the identity; null without a component that has spread."""
    project = found.projection(components)
    project = project[~np.isnan(project).any(axis=1)]
    if not len(project):
        return None
    return float(np.abs(scatter(vectors, found.mean(), project) / found.n - np.eye(len(project))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum) ** 2, exact; null beyond a long."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col), scale).alias("x")).filter("x is not null")
    source, width = padded(source)
    if not width:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    vectors = written(source.select("x").distinct())
    found = fit(vectors, width)
    error = identity_error(vectors, found, components)
    discard(vectors)
    mean, project = found.mean(), found.projection(components)
    explained = (found.values[:components] / found.trace).tolist() if found.trace > 0 else [None] * len(project)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(project)
        for b in batches:
            x = matrix(b.column(1), width)
            z = (x - mean) @ project.T
            every = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, found.n)), pa.array(deviations(x, found.n, found.sums), pa.int64()).take(every)]
                + [pa.array(z.reshape(-1), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(apply, SCHEMA)
