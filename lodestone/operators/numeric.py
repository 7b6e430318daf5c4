"""Element-wise maps, reductions and matrix operators over rows. A vector is rows (i, x), a matrix rows (i, j, x)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.portable import portable_hash
from lodestone.operators.pairs import block_pairs
from lodestone.operators.tiles import conv_tiles


# Scalars


def daxpy(a: float, x: Column, y: Column) -> Column:
    return F.lit(a) * x + y


def squared_diff(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def parity_branch(i: Column, x: Column) -> Column:
    return F.when(i % 2 == 0, x * 2).otherwise(x + 1)


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(alpha * x)


def relu_backward(x: Column, grad: Column) -> Column:
    return F.when(x > 0, grad).otherwise(0.0)


def bce(p: Column, t: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(t * F.ln(q) + (1 - t) * F.ln(1 - q))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is computed once, not once per item."""
    return F.transform(F.array(value), f)[0]


def softmax(x: Column) -> Column:
    """Of an array, shifted by its maximum."""
    e = _bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + t)
    return _bound(e, lambda a: _bound(total(a), lambda t: F.transform(a, lambda v: v / t)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """By log-sum-exp; label counts from 0."""

    def loss(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return -(F.element_at(logits, label + 1) - top) + F.ln(total)

    return _bound(F.array_max(logits), loss)


def argmax(x: Column) -> Column:
    """Place (from 0) of the first greatest item."""
    return F.array_position(x, F.array_max(x)) - 1


def dropout(i: Column, x: Column, rate: float = 0.5, seed: int = 42, training: bool = True) -> Column:
    """x, or 0 for a share of the places i; kept items are scaled up by what is left. Outside training, x itself."""
    if not training:
        return x
    return F.when(portable_hash(i, seed) < rate * 2147483648, 0.0).otherwise(x / (1 - rate))


def adam(df: DataFrame, w: str, g: str, steps: int = 5, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """df with w, m and v after so many bias-corrected steps along the same gradient."""
    out = df.withColumns({"m": F.lit(0.0), "v": F.lit(0.0)})
    for t in range(1, steps + 1):
        out = out.withColumns({"m": b1 * F.col("m") + (1 - b1) * F.col(g), "v": b2 * F.col("v") + (1 - b2) * F.col(g) * F.col(g)})
        out = out.withColumn(w, F.col(w) - lr * (F.col("m") / (1 - b1**t)) / (F.sqrt(F.col("v") / (1 - b2**t)) + eps))
    return out


# Reductions


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: total, squares, low, high, in one pass."""
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.sum(F.col(c)).alias("total"), F.sum(F.col(c) * F.col(c)).alias("squares"), F.min(c).alias("low"), F.max(c).alias("high")) for c in columns))
    return df.agg(stats.alias("s")).select(F.inline("s"))


def zscore(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """The columns as (x - mean) / (population deviation + eps); the statistics are one row and travel by broadcast."""
    stats = df.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    wide = df.join(F.broadcast(stats))
    return wide.withColumns({c: (F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + eps) for i, c in enumerate(columns)}).select(df.columns)


def minmax(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """The columns as (x - min) / range; 0 where the range is no more than eps."""
    stats = df.agg(*(F.min(c).alias(f"_a{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"_b{i}") for i, c in enumerate(columns)))
    wide = df.join(F.broadcast(stats))
    span = lambda i: F.col(f"_b{i}") - F.col(f"_a{i}")
    return wide.withColumns({c: F.when(span(i) > eps, (F.col(c) - F.col(f"_a{i}")) / span(i)).otherwise(0.0) for i, c in enumerate(columns)}).select(df.columns)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin, n for every bin from 0, empty ones included."""
    counts = df.select(value.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pi_integral(spark: SparkSession, steps: int) -> DataFrame:
    x = (F.col("id") + 0.5) / steps
    return spark.range(steps).agg((F.sum(4 / (1 + x * x)) / steps).alias("pi"))


def primes(spark: SparkSession, n: int) -> DataFrame:
    """Primes from 2 to n: every number's divisors up to its root are tried."""
    tried = F.exists(F.sequence(F.lit(2).cast("long"), F.floor(F.sqrt("id"))), lambda d: F.col("id") % d == 0)
    return spark.range(2, n + 1).filter((F.col("id") < 4) | ~tried).select(F.col("id").alias("n"))


def perfect_numbers(spark: SparkSession, n: int) -> DataFrame:
    """Numbers from 2 to n that equal the sum of their divisors, summed in pairs up to the root."""
    root = F.floor(F.sqrt("id"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), root), F.lit(0).cast("long"), lambda s, d: F.when(F.col("id") % d != 0, s).otherwise(s + d + F.when((d > 1) & (d * d != F.col("id")), F.floor(F.col("id") / d)).otherwise(0)))
    return spark.range(2, n + 1).filter(total == F.col("id")).select(F.col("id").alias("n"))


# Matrices


def to_cells(df: DataFrame, row: str, values: str) -> DataFrame:
    """i, j, x of a table with an array per row."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))


#: Side of the square blocks in which matrices are multiplied.
SIDE = 128


def _blocks(cells: DataFrame, row: str, column: str, names: tuple[str, str], side: str) -> DataFrame:
    """Cells (i, j, x) by blocks of SIDE x SIDE: the block's row and column, and its cells as three arrays. Cells without a value aren't there."""
    at = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    cell = F.struct((F.col(row) - at(row) * SIDE).cast("int").alias("p"), (F.col(column) - at(column) * SIDE).cast("int").alias("q"), F.col("x").cast("double").alias("x"))
    blocks = cells.filter("x IS NOT NULL").groupBy(at(row).alias(names[0]), at(column).alias(names[1])).agg(F.collect_list(cell).alias("cells"))
    return blocks.select(*names, *(F.col(f"cells.{c}").alias(f"{side}_{c}") for c in "pqx"))


def _dense(batch: pa.RecordBatch, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's block as a full matrix, and where it has cells."""
    ends = np.asarray(batch.column(f"{side}_p").offsets)
    ends = ends - ends[0]
    p, q, x = (batch.column(f"{side}_{c}").flatten().to_numpy() for c in "pqx")
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        full, there = np.zeros((SIDE, SIDE)), np.zeros((SIDE, SIDE))
        np.add.at(full, (p[a:b], q[a:b]), x[a:b])
        there[p[a:b], q[a:b]] = 1
        yield full, there


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, x of the product of cells (i, j, x); a cell is there where at least one inner index meets. Blocks of SIDE x SIDE cells are joined on the inner block, multiplied in numpy, and their cells summed: SIDE times fewer products are shuffled than cell by cell, and a popular inner index is spread over its blocks."""
    joined = _blocks(a, "i", "j", ("bi", "bk"), "left").join(_blocks(b, "i", "j", ("bk", "bj"), "right"), "bk")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, (x, in_x), (y, in_y) in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), _dense(batch, "left"), _dense(batch, "right"), strict=True):
                i, j = np.nonzero(in_x @ in_y)
                yield pa.RecordBatch.from_arrays([pa.array(bi * SIDE + i), pa.array(bj * SIDE + j), pa.array((x @ y)[i, j])], ["i", "j", "x"])

    parts = joined.drop("bk").mapInArrow(multiply, "i long, j long, x double")
    return parts.groupBy("i", "j").agg(F.sum("x").alias("x"))


def gram(rows: DataFrame, values: str, width: int, about: Sequence[float] | None = None) -> DataFrame:
    """i >= j, x: dot products of the columns of a tall matrix with an array of `width` numbers in every row, each less `about`; column `width` is all ones, so that x(width, j) is the sum of j and x(width, width) the number of rows.

    Every task sums the products of its rows into one matrix: the shuffle carries width**2 / 2 cells a task, whatever the rows. Null arrays are left out; an array of another length raises."""
    shift = np.zeros(width) if about is None else np.array(about, dtype=float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            x = b.column("x").drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) - shift
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        i, j = np.tril_indices(width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(total[i, j])], ["i", "j", "x"])

    return rows.select(F.col(values).cast("array<double>").alias("x")).mapInArrow(task, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))


def correlation_rows(rows: DataFrame, values: str, width: int) -> DataFrame:
    """i >= j, r: Pearson's r of the places of an array, over all rows; null where a place is constant. One pass: products of the differences from some row, which are small where values are large, put right by their means."""
    some = rows.filter(F.col(values).isNotNull()).select(F.col(values).cast("array<double>").alias("x")).head()
    if some is None:
        return rows.sparkSession.createDataFrame([], "i long, j long, r double")
    sums = gram(rows, values, width, some.x).collect()  # width**2 / 2 cells
    full = np.zeros((width + 1, width + 1))
    for c in sums:
        full[c.i, c.j] = full[c.j, c.i] = c.x
    n, total = full[width, width], full[width, :width]
    moments = full[:width, :width] - np.outer(total, total) / n
    own = np.diag(moments).copy()
    own[own <= 1e-14 * np.diag(full)[:width]] = np.nan  # what is left of a constant place by rounding
    with np.errstate(all="ignore"):
        r = moments / np.sqrt(np.outer(own, own))
    i, j = np.tril_indices(width)
    cells = pa.table({"i": pa.array(i.astype(np.int64)), "j": pa.array(j.astype(np.int64)), "r": pa.array(r[i, j], from_pandas=True)})
    return rows.sparkSession.createDataFrame(cells)


def correlation_matrix(cells: DataFrame, width: int) -> DataFrame:
    """correlation_rows of the series j, each a column of cells (i: observation, j: series), all of which must be there."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda c: c.x)
    return correlation_rows(cells.groupBy("i").agg(values.alias("v")), "v", width)


def distance_matrix(rows: DataFrame, key: str, values: str, blocks: int | None = None) -> DataFrame:
    """a <= b, distance: Euclid's, between all rows (filter them before for a subset)."""
    pairs = block_pairs(rows.select(F.col(key).cast("long").alias("k"), F.col(values).alias("v")), "k", blocks, include_self=True)
    total = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, t: s + t)
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.sqrt(total).alias("distance"))


def batchnorm(cells: DataFrame, eps: float = 1e-5, gamma: float = 1.0, beta: float = 0.0) -> DataFrame:
    """cells (n, c, hw, x) with x normalised by its channel's mean and population variance."""
    stats = cells.groupBy("c").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    return cells.join(stats, "c").select("n", "c", "hw", (gamma * (F.col("x") - F.col("mean")) / F.sqrt(F.col("var") + eps) + beta).alias("x"))


def max_pool(cells: DataFrame, height: int, width: int) -> DataFrame:
    """n, h, w, x: the maximum of each 2 x 2 window of cells (n, h, w, x); an odd edge is dropped."""
    kept = cells.filter((F.col("h") < height // 2 * 2) & (F.col("w") < width // 2 * 2))
    return kept.groupBy("n", F.floor(F.col("h") / 2).alias("h"), F.floor(F.col("w") / 2).alias("w")).agg(F.max("x").alias("x"))


def conv2d(cells: DataFrame, kernel: Sequence[Sequence[float]], height: int, width: int) -> DataFrame:
    """n, h, w, x: cells (n, h, w, x) with zero padding under an odd kernel, on tiles; images that fit a row need no shuffle, see `tiles.conv_rows`."""
    return conv_tiles(cells, kernel, height, width)


def heat_grid(spark: SparkSession, size: int) -> DataFrame:
    """i, j, t: a cold square with 100 at its centre."""
    cell = spark.range(size * size).select(F.floor(F.col("id") / size).alias("i"), (F.col("id") % size).alias("j"))
    return cell.withColumn("t", F.when((F.col("i") == size // 2) & (F.col("j") == size // 2), 100.0).otherwise(0.0))


def heat_totals(grid: DataFrame, size: int, steps: int) -> DataFrame:
    """step, total: the grid's sum after each of so many steps."""
    out, now = None, grid
    for n in range(1, steps + 1):
        now = cut(heat_steps(now, size, 1))
        total = now.agg(F.lit(n).cast("long").alias("step"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"))
        out = total if out is None else out.unionByName(total)
    return out


def heat_steps(grid: DataFrame, size: int, steps: int) -> DataFrame:
    """The grid's warm cells after so many steps, each inner cell the mean of its four neighbours, the border cold."""
    moves = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    for n in range(steps):
        sent = grid.filter("t <> 0").select("i", "j", "t", F.inline(moves)).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("t") / 4).alias("t"))
        kept = sent.filter(F.col("i").between(1, size - 2) & F.col("j").between(1, size - 2)).groupBy("i", "j").agg(F.sum("t").alias("t"))
        grid = cut(kept) if n % 4 == 3 else kept
    return grid


def _energies(pairs: DataFrame) -> DataFrame:
    """a, b, energy, fx, fy, fz of pairs of particles (a, b), the force on a; null where both are at one place."""
    d = {c: F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"}
    r2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    near = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *(d[c].alias(f"d{c}") for c in "xyz"), F.try_divide(F.lit(1.0), r2).alias("i2")).withColumn("i6", F.col("i2") * F.col("i2") * F.col("i2"))
    pull = 24 * F.col("i2") * F.col("i6") * (2 * F.col("i6") - 1)
    return near.select("a", "b", (4 * F.col("i6") * (F.col("i6") - 1)).alias("energy"), *((pull * F.col(f"d{c}")).alias(f"f{c}") for c in "xyz"))


def lennard_jones(particles: DataFrame, blocks: int | None = None) -> DataFrame:
    """a < b, energy, fx, fy, fz: of every pair of particles (id, x, y, z), the force on a; null where both are at one place."""
    return _energies(block_pairs(particles, "id", blocks))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """id, fx, fy, fz: sums of equal and opposite forces on both of a pair."""
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id"), "fx", "fy", "fz"), F.struct(F.col("b").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy"), (-F.col("fz")).alias("fz")))))
    return both.groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"))


#: Particles of a block of `met`; a task lays a tile of TILE_ROWS of them beside another block.
PARTICLES, TILE_ROWS = 4000, 128
_POINTS = ("id", "x", "y", "z")


def _meet(p: list[np.ndarray], q: list[np.ndarray]) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of two blocks (ids, x, y, z), but for those of one id or at one place: energy, number, forces on either block's particles (3 x rows) and the pairs that those have."""
    energy, on_p, on_q, n_p, n_q = 0.0, np.zeros((3, len(p[0]))), np.zeros((3, len(q[0]))), np.zeros(len(p[0]), np.int64), np.zeros(len(q[0]), np.int64)
    for at in range(0, len(p[0]), TILE_ROWS):
        tile = slice(at, at + TILE_ROWS)
        d = [u[tile, None] - v[None] for u, v in zip(p[1:], q[1:], strict=True)]
        r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        there = (p[0][tile, None] != q[0][None]) & (r2 != 0)
        i2 = np.divide(1.0, r2, out=np.zeros_like(r2), where=there)
        i6 = i2 * i2 * i2
        energy += float((4 * i6 * (i6 - 1)).sum())
        pull = 24 * i2 * i6 * (2 * i6 - 1)
        n_p[tile] = there.sum(1)
        n_q += there.sum(0)
        for k in range(3):
            if not there.all():
                d[k][~there] = 0.0
            force = pull * d[k]
            on_p[k, tile] = force.sum(1)
            on_q[k] -= force.sum(0)
    return energy, int(n_p.sum()), on_p, on_q, n_p, n_q


def _met(particles: DataFrame, blocks: int | None, work: Callable[[list[np.ndarray], list[np.ndarray] | None], pa.RecordBatch], schema: str) -> DataFrame:
    """What `work` makes of every two blocks of particles (id, x, y, z), or of one with itself (None). A row holds a block, so that pairs are formed in numpy and none is shuffled."""
    spark = particles.sparkSession
    rows = particles.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna()
    if blocks is None:
        blocks = max(math.ceil(rows.count() / PARTICLES), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)))
    own = F.pmod(F.xxhash64(*_POINTS), F.lit(blocks)).cast("long")
    packed = rows.groupBy(own.alias("own")).agg(F.collect_list(F.struct(*_POINTS)).alias("p")).select("own", *(F.col(f"p.{c}").alias(c) for c in _POINTS))
    sent = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"), "own", *_POINTS)
    meet = F.least("own", "other") * blocks + F.greatest("own", "other")
    pairs = sent.select(meet.alias("meet"), (F.col("own") == F.col("other")).alias("alone"), *_POINTS).repartition(min(1000, blocks * (blocks + 1) // 2), "meet").groupBy("meet", "alone").agg(F.collect_list(F.struct(*_POINTS)).alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                sides = b.column("sides")[i].values
                held = [[sides.field(c)[k].values.to_numpy() for c in _POINTS] for k in range(len(sides))]
                if b.column("alone")[i].as_py():
                    yield work(held[0], None)
                elif len(held) == 2:  # the other block may be empty
                    yield work(*held)

    return pairs.filter(F.col("alone") | (F.size("sides") == 2)).mapInArrow(run, schema)


def energy(particles: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row, energy: of all pairs of particles (id, x, y, z) but those at one place; null without any."""

    def work(p: list[np.ndarray], q: list[np.ndarray] | None) -> pa.RecordBatch:
        e, n, *_ = _meet(p, p if q is None else q)
        return pa.RecordBatch.from_arrays([pa.array([(e / 2 if q is None else e) if n else None], pa.float64())], ["energy"])

    return _met(particles, blocks, work, "energy double").agg(F.sum("energy").alias("energy"))


def forces(particles: DataFrame, blocks: int | None = None) -> DataFrame:
    """id, fx, fy, fz: the sum over all partners, equal and opposite on both of a pair; null where all are at one place. A particle alone has no row."""

    def work(p: list[np.ndarray], q: list[np.ndarray] | None) -> pa.RecordBatch:
        _, _, on_p, on_q, n_p, n_q = _meet(p, p if q is None else q)
        if q is not None:
            p, on_p, n_p = [np.concatenate((p[0], q[0]))], np.hstack((on_p, on_q)), np.concatenate((n_p, n_q))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (p[0], n_p, *on_p)], ["id", "n", "fx", "fy", "fz"])

    sums = _met(particles, blocks, work, "id long, n long, fx double, fy double, fz double").groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("n"), *(F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"))
    ids = particles.select("id").dropna().distinct()
    if ids.limit(2).count() < 2:
        ids = ids.limit(0)
    return ids.join(sums, F.col("id") == F.col("_id"), "left").select("id", *(F.when(F.col("n") > 0, F.col(f"f{c}")).alias(f"f{c}") for c in "xyz"))


#: Particles of a cell of space that a task lays beside another cell's at most.
CELL_ROWS = 2000


def near_pairs(particles: DataFrame, cutoff: float) -> DataFrame:
    """a < b (structs of particles): those no farther apart than the cutoff, which are in the same cell of space or in neighbouring ones. A cell of more than CELL_ROWS particles is shared out: its rows meet others in parts, so that no task holds all of them."""
    at = F.struct(*(F.floor(F.col(c) / cutoff).cast("long").alias(f"c{c}") for c in "xyz"))
    placed = particles.select(F.struct("id", *"xyz").alias("p"), at.alias("cell"))
    shares = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("shares"))
    own = placed.join(shares, "cell").select(F.col("p").alias("a"), "cell", F.pmod(F.xxhash64("p.id"), F.col("shares")).cast("int").alias("share"))
    steps = F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{c}") for c, d in zip("xyz", step, strict=True))) for step in itertools.product((-1, 0, 1), repeat=3)))
    around = placed.select("p", "cell", F.explode(steps).alias("d")).select(F.col("p").alias("b"), F.struct(*((F.col(f"cell.c{c}") + F.col(f"d.d{c}")).alias(f"c{c}") for c in "xyz")).alias("cell"))
    sent = around.join(shares, "cell").select("b", "cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    r2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0))
    return own.join(sent, ["cell", "share"]).filter((F.col("a.id") < F.col("b.id")) & (r2 <= cutoff * cutoff)).select("a", "b")


def lennard_jones_near(particles: DataFrame, cutoff: float) -> DataFrame:
    """One row: pairs no farther apart than the cutoff, their energy, and left_out, a bound on how much all other pairs together could add or take: beyond 2^(1/6), where the curve only rises towards 0, a pair has at most the depth at the cutoff."""
    if cutoff < 2 ** (1 / 6):
        raise ValueError("the cutoff must lie beyond the curve's lowest point")
    n = particles.count()
    total = _energies(near_pairs(particles, cutoff)).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"))
    depth = 4 * (cutoff**-6 - cutoff**-12)
    return total.select("pairs", "energy", ((F.lit(n * (n - 1) / 2) - F.col("pairs")) * depth).alias("left_out"))


def forces_near(particles: DataFrame, cutoff: float) -> DataFrame:
    """id, fx, fy, fz of every particle: the sum over partners no farther than the cutoff; 0 without any."""
    pairs = _energies(near_pairs(particles, cutoff))
    return particles.select("id").join(_both_ways(pairs), "id", "left").select("id", *(F.coalesce(f"f{c}", F.lit(0.0)).alias(f"f{c}") for c in "xyz"))
