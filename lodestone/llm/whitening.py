"""Embedding whitening: a distributed covariance, its eigenvectors by Jacobi's rotations, and the vectors in their terms."""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lodestone.llm.common import map_batches
from lodestone.llm.vectors import held, summed, usable, width_of

EPSILON = float(np.finfo(float).eps)
#: Sweeps after which a matrix is taken as it is; symmetric ones take some ten.
SWEEPS = 100
#: Vectors whose rows are made at once.
ROWS = 2048
#: What keeps a vector's integers above zero, and the largest of them: entries beyond 2^38 count as that.
OFFSET, GREATEST = 1_000_000, 1 << 44


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue. Rows and columns are turned pair by pair, in order, until every entry off the diagonal is nothing beside the two diagonal entries it stands between, which leaves small eigenvalues their digits."""
    a, d = np.array(symmetric, dtype=float), len(symmetric)
    v, nothing = np.eye(d), EPSILON * EPSILON * abs(float(np.trace(a)))
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off, x, y = float(a[p, q]), float(a[p, p]), float(a[q, q])
                if abs(off) <= max(EPSILON * sqrt(abs(x * y)), nothing):
                    continue
                turned = True
                theta = (y - x) / (2 * off)
                t = (1 if theta >= 0 else -1) / (abs(theta) + hypot(1, theta))
                c = 1 / hypot(1, t)
                s = t * c
                for m in (a, a.T, v):  # columns, rows, and the vectors' columns
                    first = m[:, p].copy()
                    m[:, p] = c * first - s * m[:, q]
                    m[:, q] = s * first + c * m[:, q]
                a[p, p], a[q, q] = x - t * off, y + t * off
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x * scale), -GREATEST, GREATEST).astype(np.int64) + OFFSET


def whiten(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for every vector of df and each of its leading components.

    Three passes: the integer sums; the centred products, one width x width matrix a task; the whitened covariance, by which identity_error is measured.
    The driver holds one such matrix. Null vectors, those with a null or non-finite entry, and those of another length than most have no row; ids may be
    null or repeated, and every row counts. A component without variance (all vectors alike, or fewer of them than dimensions) has null as whitened and stays out
    of identity_error, which is 0 if there is no other; explained is null where nothing varies. deviation is null where it exceeds 64 bits.
    An empty table gives no rows. Other columns of df, whatever their names, are left out."""
    kind = df.schema["vec_id"].dataType
    fields = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]
    schema = StructType([StructField("vec_id", kind), *(StructField(*f) for f in fields)])
    vectors = held(df, vector, "vec_id")
    width = width_of(vectors)
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    n, sums = summed(vectors, width, lambda x: (integers(x, scale) - OFFSET).sum(axis=0))
    # the mean as an integer and a remainder: x - S / n loses no digits to the offset
    whole, rest = sums // n + OFFSET, sums % n

    def centred(x: np.ndarray) -> np.ndarray:
        return (integers(x, scale) - whole) - rest / n

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    _, scatter = summed(vectors, width, products)
    values, axes = jacobi(scatter / n)
    total, k = float(values.sum()), min(components, width)
    varies = values[:k] > width * EPSILON * max(float(values[0]), 0.0)
    matrix = axes[:, :k] / np.sqrt(np.where(varies, values[:k], 1.0))
    held_matrix = df.sparkSession.sparkContext.broadcast(matrix)

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ held_matrix.value
        return np.vstack([w.T @ w, w.sum(axis=0)])

    _, sent = summed(vectors, width, whitened_products)
    mean = sent[k] / n
    off = np.abs(sent[:k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(varies, varies)]
    error = float(off.max(initial=0.0))
    explained = [float(e) / total if total > 0 else None for e in values[:k]]

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2 in exact integers."""
        c = integers(x, scale) - whole
        if n * (float(np.abs(c).max(initial=0)) + 1) < 2.0**31 / sqrt(width):
            d = n * c - rest
            return (d * d).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in c.tolist()]
        return [d if d < 1 << 63 else None for d in exact]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(start, ROWS)
                at, x = usable(b.column("x"), width)
                if not len(at):
                    continue
                w = centred(x) @ held_matrix.value
                rows, places = pa.array(np.repeat(np.arange(len(at)), k)), np.tile(np.arange(k), len(at))
                columns = [b.column("vec_id").take(pa.array(at)).take(rows), pa.array((places + 1).astype(np.int32)), pa.array(np.full(len(places), n)), pa.array(deviations(x), pa.int64()).take(rows), pa.array(w.ravel(), mask=~varies[places]), pa.array(explained, pa.float64()).take(pa.array(places)), pa.array(np.full(len(places), error))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return map_batches(vectors, task, schema)
