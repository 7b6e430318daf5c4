"""Vector code compression: product codes of integer vectors, whose codebooks Lloyd's rounds make and kd-trees search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.llm.common import map_batches, written
from lodestone.llm.vectors import held, usable, width_of

#: Entries of a codebook that a leaf of its tree holds at most.
LEAF = 16
#: Integer components beyond this count as it (entries of a vector beyond 65,536), so that all sums of squares fit 64 bits.
GREATEST = 1 << 26
#: Vectors that are assigned at once.
ROWS = 8192
#: Sums by label up to this many labels are broadcast to the codes.
BROADCAST_LABELS = 100_000


class Tree:
    """A kd-tree over the entries of a codebook, searched for a whole block of points at once."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int, int]] = []  # box, members, axis, cut, children
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        me, e = len(self.nodes), self.entries[members]
        lo, hi = e.min(axis=0), e.max(axis=0)
        self.nodes.append((lo, hi, members, -1, 0, -1, -1))
        spread = hi - lo
        axis = int(spread.argmax()) if len(spread) else -1
        if len(members) <= LEAF or axis < 0 or spread[axis] == 0:
            return me
        order = np.sort(e[:, axis])
        cut = int(order[(len(order) - 1) // 2])
        if cut == order[-1]:  # the upper half is one value: all below it goes left
            cut = int(order[order < cut][-1])
        goes = e[:, axis] <= cut
        left, right = self._grow(members[goes]), self._grow(members[~goes])
        self.nodes[me] = (lo, hi, members, axis, cut, left, right)
        return me

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for every row of x: the nearest entry, of equally near ones the first.

        Every point looks into the leaf on its own side of all cuts first. Then the tree is walked once for all points; a point enters a box that is no
        farther than its best entry so far. Boxes at just that distance are entered too, as they may hold an entry of a lower index."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = np.float64 if x.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64  # either is without rounding
        x, entries = x.astype(exact), self.entries.astype(exact)
        norms, own = (entries * entries).sum(axis=1), (x * x).sum(axis=1)
        best = np.full(len(x), np.iinfo(np.int64).max, dtype=exact)
        found, home = np.zeros(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)

        def look(node: int, rows: np.ndarray) -> None:
            members = self.nodes[node][2]
            d = own[rows, None] - 2 * (x[rows] @ entries[members].T) + norms[members]
            k = d.argmin(axis=1)
            near, entry = d[np.arange(len(rows)), k], members[k]
            wins = (near < best[rows]) | ((near == best[rows]) & (entry < found[rows]))
            best[rows[wins]], found[rows[wins]] = near[wins], entry[wins]

        def descend(node: int, rows: np.ndarray) -> None:
            _, _, _, axis, cut, left, right = self.nodes[node]
            if not len(rows):
                return
            if axis < 0:
                home[rows] = node
                look(node, rows)
                return
            goes = x[rows, axis] <= cut
            descend(left, rows[goes])
            descend(right, rows[~goes])

        def walk(node: int, rows: np.ndarray) -> None:
            lo, hi, _, axis, _, left, right = self.nodes[node]
            p = x[rows]
            gap = np.maximum(lo - p, 0) + np.maximum(p - hi, 0)
            rows = rows[(gap * gap).sum(axis=1) <= best[rows]]
            if axis < 0:
                rows = rows[home[rows] != node]
                if len(rows):
                    look(node, rows)
            elif len(rows):
                walk(left, rows)
                walk(right, rows)

        everyone = np.arange(len(x))
        descend(0, everyone)
        if self.nodes[0][3] >= 0:
            walk(0, everyone)
        return found, best.astype(np.int64)


def _integers(x: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """n x parts x width: floor(scale * x), cut into equal parts; zeros make up a last part that is too short."""
    whole = np.clip(np.floor(x * scale), -GREATEST, GREATEST).astype(np.int64)
    wide = -(-x.shape[1] // parts) * parts
    return np.pad(whole, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), parts, wide // parts)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            b = whole.slice(start, ROWS)
            at, x = usable(b.column("x"), width)
            if len(at):
                yield b, at, _integers(x, scale, parts)


def _seeds(vectors: DataFrame, width: int, scale: int, parts: int, size: int) -> np.ndarray:
    """parts x entries x width: the integer vectors of the least ids in order, repeated ids by their integers; vectors without an id come after all others."""
    kind = vectors.schema["vec_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x in _blocks(batches, width, scale, parts):
            flat = x.reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(list(flat), pa.list_(pa.int64()))], ["vec_id", "v"])

    first = map_batches(vectors, task, f"vec_id {kind.dataType.simpleString()}, v array<long>").orderBy(F.asc_nulls_last("vec_id"), "v").limit(size).collect()
    return np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def codebooks(vectors: DataFrame, width: int, scale: int = 1024, parts: int = 4, size: int = 256, rounds: int = 4) -> np.ndarray:
    """parts x entries x width after the given rounds. A round is one job: trees go to all tasks by broadcast (their size is fixed by parts, size and width), the integer sums and counts of every entry come back."""
    books = _seeds(vectors, width, scale, parts, size)
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        trees = sc.broadcast([Tree(b) for b in books])

        def task(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            k, w = trees.value[0].entries.shape
            sums, counts = np.zeros((parts, k, w), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
            for _, _, x in _blocks(batches, width, scale, parts):
                for p, tree in enumerate(trees.value):
                    entry, _ = tree.nearest(x[:, p])
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p], first, axis=0)
                    counts[p] += np.bincount(entry, minlength=k)
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        w = books.shape[2]
        total: list[Column] = [F.sum(F.col("s")[i]) for i in range(w)]
        sent = map_batches(vectors.select("x"), task, "part int, entry int, n long, s array<long>")
        for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*total).alias("s")).collect():
            books[r.part, r.entry] = np.array(r.s, dtype=np.int64) // r.n  # numpy's // goes down
        trees.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """The hex SHA-256 of all components by part, entry and position, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, width: int, scale: int = 1024) -> DataFrame:
    """vec_id, label, codes (entry of every part) and error (squared distances summed over parts) of every usable vector."""
    trees, parts = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books]), len(books)
    digits = 2 if books.shape[1] <= 256 else 4

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x in _blocks(batches, width, scale, parts):
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
            codes = np.stack([e for e, _ in found], axis=1)
            text = codes.astype(np.uint8 if digits == 2 else ">u2").tobytes().hex()
            step, rows = digits * parts, pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("label").take(rows), pa.array([text[i : i + step] for i in range(0, len(text), step)]), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    kinds = [StructField(c, vectors.schema[c].dataType) for c in ("vec_id", "label")]
    return map_batches(vectors, task, StructType([*kinds, StructField("code", StringType()), StructField("error", LongType())]))


def compress(df: DataFrame, vector: str = "embedding", scale: int = 1024, parts: int = 4, size: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector of df.

    Null vectors, those with a null or non-finite entry, and those of another length than most have no row. Fewer vectors than `size` make smaller
    codebooks; of repeated ids all rows seed and are coded; ids and labels may be null, null labels being one label. A length that isn't a multiple of
    `parts` is made one by zeros. An empty table gives no rows. Other columns of df, whatever their names, are left out."""
    vectors = held(df, vector, "vec_id", "label")
    width = width_of(vectors)
    if not width:
        return df.sparkSession.createDataFrame([], StructType([StructField("vec_id", df.schema["vec_id"].dataType), StructField("label", df.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]))
    books = codebooks(vectors, width, scale, parts, size, rounds)
    coded = written(encode(vectors, books, width, scale), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(digest(books)))
