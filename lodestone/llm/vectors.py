"""Vectors of a table as matrices inside Arrow batches, and sums of matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lodestone.llm.common import map_batches


def held(df: DataFrame, vector: str, *others: str) -> DataFrame:
    """The vector (entries of any numeric type) as `x`, with other columns; all else is left behind at the scan."""
    same = df.schema[vector].dataType == ArrayType(FloatType())
    return df.select(*others, F.col(vector).cast("array<float>" if same else "array<double>").alias("x"))


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors with `width` entries, none of them null, infinite or not a number, and these as a matrix of doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    if not len(at) or not width:
        return at, np.empty((len(at), width))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
    ok = np.isfinite(x).all(axis=1)
    return at[ok], x[ok]


def width_of(vectors: DataFrame) -> int:
    """The length that most vectors without null or non-finite entries have, of ties the greatest; 0 where there is no such vector."""
    whole = vectors.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    most = whole.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return most.width if most else 0


def summed(vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """How many usable vectors there are, and the sum of `part` of their matrices over all batches. Every task sends the cells of one matrix, the driver gets them once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            _, x = usable(b.column("x"), width)
            if len(x):
                n, total = n + len(x), part(x) if total is None else total + part(x)
        if total is not None:
            kind = pa.int64() if total.dtype.kind == "i" else pa.float64()
            counts = np.zeros(total.size, dtype=np.int64)
            counts[0] = n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel(), kind), pa.array(counts)], ["cell", "v", "n"])

    probe = part(np.zeros((0, width)))
    kind = "long" if probe.dtype.kind == "i" else "double"
    cells = map_batches(vectors.select("x"), task, f"cell long, v {kind}, n long").groupBy("cell").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out = np.zeros(probe.size, dtype=np.int64 if kind == "long" else np.float64)
    for r in cells:
        out[r.cell] = r.v
    return sum(r.n for r in cells), out.reshape(probe.shape)
