"""Stencils on images and grids: inside a row where the image fits one, otherwise on square tiles that get their neighbours' borders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Side of a tile.
TILE = 256


def correlate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Images (n, height, width), framed by zeros, under an odd kernel: out[h, w] = sum of kernel[p, q] * x[h - reach + p, w - reach + q]."""
    reach = len(kernel) // 2
    _, high, wide = x.shape
    framed = np.pad(x, ((0, 0), (reach, reach), (reach, reach)))
    out = np.zeros_like(x)
    for p, row in enumerate(kernel):
        for q, k in enumerate(row):
            if k:
                out += k * framed[:, p : p + high, q : q + wide]
    return out


def conv_rows(df: DataFrame, values: str, kernel: Sequence[Sequence[float]], height: int, width: int) -> DataFrame:
    """df with the image of every row (height * width numbers, row by row) under the kernel. Nothing is shuffled. A null image stays null, null pixels count as 0; an image of another size raises."""
    k, names = np.array(kernel, dtype=float), df.columns
    fields = [StructField(f.name, ArrayType(DoubleType()) if f.name == values else f.dataType) for f in df.schema]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = b.column(values)
            there = np.flatnonzero(images.is_valid().to_numpy(zero_copy_only=False))
            x = np.nan_to_num(images.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(float), posinf=np.inf, neginf=-np.inf).reshape(len(there), height, width)
            out: list[np.ndarray | None] = [None] * len(images)
            for i, image in zip(there.tolist(), correlate(x, k).reshape(len(there), -1), strict=True):
                out[i] = image
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if c == values else b.column(c) for c in names], names)

    return df.select(*(F.col(c).cast("array<double>").alias(c) if c == values else F.col(c) for c in df.columns)).mapInArrow(task, StructType(fields))


def conv_tiles(cells: DataFrame, kernel: Sequence[Sequence[float]], height: int, width: int, tile: int = TILE) -> DataFrame:
    """n, h, w, x: cells (n, h, w, x) of images of any size under the kernel; a cell is there where the kernel meets at least one.

    A cell goes to its tile, and to the tiles beside it only where it lies within the kernel's reach of them: one shuffle of little more than the cells."""
    k = np.array(kernel, dtype=float)
    reach = len(k) // 2
    if tile < reach:
        raise ValueError("a tile must be as wide as the kernel's reach")
    side = tile + 2 * reach

    def near(c: str, size: int):  # noqa: ANN202
        """The tiles along an axis whose frame holds the place."""
        least, most = F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)
        return F.sequence(F.greatest(least, F.lit(0).cast("long")), F.least(most, F.lit((size - 1) // tile).cast("long")))

    sent = cells.select("n", "h", "w", F.col("x").cast("double").alias("x")).withColumn("th", F.explode(near("h", height))).withColumn("tw", F.explode(near("w", width)))

    def stencil(group: pa.Table) -> pa.Table:
        n, th, tw = (group.column(c)[0].as_py() for c in ("n", "th", "tw"))
        h, w, x = (group.column(c).to_numpy() for c in ("h", "w", "x"))
        framed, there = np.zeros((1, side, side)), np.zeros((1, side, side))
        at = (0, h - th * tile + reach, w - tw * tile + reach)
        np.add.at(framed, at, np.nan_to_num(x))
        there[at] = 1
        inner = (0, slice(reach, reach + min(tile, height - th * tile)), slice(reach, reach + min(tile, width - tw * tile)))
        out, met = correlate(framed, k)[inner], correlate(there, np.ones_like(k))[inner] > 0
        a, b = np.nonzero(met)
        return pa.table({"n": pa.array([n] * len(a), pa.int64()), "h": pa.array(a + th * tile), "w": pa.array(b + tw * tile), "x": pa.array(out[a, b])})

    return sent.groupBy("n", "th", "tw").applyInArrow(stencil, "n long, h long, w long, x double")
