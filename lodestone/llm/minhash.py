"""Near-duplicate groups by circulant MinHash.

A text's set holds the hashes of its distinct shingles (all its words as one, if there are fewer). Two permutations
make the whole signature: the first scatters the shingles over the 32-bit circle, the second ranks the circle shifted
by k for coordinate k, and the coordinate is the least rank. Bands of the signature make buckets.

1. Texts with equal sets make one class, so that copies take part once.
2. Classes that share a bucket, directly or through others, make a loose cluster. That costs a star of edges per
   bucket, never its pairs.
3. Each class sends its whole set once to its cluster, where the links are found exactly: from a class outward, the
   classes not yet reached are counted against it through an inverted list, and linked ones are followed in turn.
   Clusters of more than BLOCK shingles are dealt out in blocks, each pair of which is searched by a task of its own.
4. Components of these links are the groups; nothing but ids is joined back to the documents.

Edge cases: texts without words, and null texts, have an empty set and are alone in their group; ties don't matter, as a
group's id is its least doc_id; repeated rows are one class and each gets its row; two texts under one doc_id are two
classes; rows with a null doc_id are grouped under the least id of their group, null if it has none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ROW, cut, keyed, map_batches, without
from lodestone.llm.components import components
from lodestone.llm.hashing import SPACED, combine, hashes_of, mix

#: Shingles of a cluster that one task takes at most; a larger cluster is searched in blocks of half as many.
BLOCK = 4_000_000
#: Shingles of all blocks that a task searches one after another, on average.
PER_TASK = 8_000_000
#: Classes up to this many are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_CLASSES = 400_000
#: The chance that two sets at the threshold share no bucket.
MISS = 1e-4


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest rows for which 32 bands find sets at the threshold but for a chance of MISS."""
    j, bands = percent / 100, 32
    rows = 1
    while (1 - j ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows, bands


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return h
    return np.unique(combine(h, range(min(width, len(h)))))


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of the second permutation over the first's places, shifted by k."""
    place = (mix(s + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(place), 2048):
        x = place[None, at : at + 2048] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in b.column("text").to_pylist()]


def signatures(rows_of: DataFrame, width: int, percent: int) -> DataFrame:
    """the row, n_shingles, digest (of the set, null for the empty one), bands (a hash of each band's rows)."""
    rows, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, keys = np.zeros(b.num_rows, dtype=np.int64), [None] * b.num_rows, [None] * b.num_rows
            for i, h in hashes_of(_texts(b), SPACED):
                s = shingle_set(h, width)
                if len(s):
                    sizes[i], digests[i] = len(s), blake2b(s.tobytes(), digest_size=16).digest()
                    table = signature(s, rows * bands).reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                    for r in range(rows):
                        key = mix(key + table[:, r])
                    keys[i] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(ROW), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[ROW, "n_shingles", "digest", "bands"])

    return map_batches(rows_of.select(ROW, "text"), run, f"{ROW} long, n_shingles long, digest binary, bands array<long>")


def links(sets: Sequence[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by index."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(codes, kind="stable")
    left = np.ones(n, dtype=bool)  # not yet reached

    def lists(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = order[alive[owner[order]]]
        return owner[kept], np.searchsorted(codes[kept], np.arange(codes.max() + 2))

    holders, bounds = lists(left)
    built, forest = n, []
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            remaining = int(left.sum())
            if not remaining:
                break
            if remaining < built // 2:
                holders, bounds = lists(left)
                built = remaining
            mine = codes[start[x] : start[x + 1]]
            low, high = bounds[mine], bounds[mine + 1]
            lengths = high - low
            total = int(lengths.sum())
            if not total:
                continue
            at = np.repeat(low - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
            both = np.bincount(holders[at], minlength=n)
            found = np.flatnonzero(left & (both > 0) & (100 * both >= percent * (size[x] + size - both)))
            left[found] = False
            forest += [(x, int(y)) for y in found]
            queue += found.tolist()
    return forest


def cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: a forest of the links within each block pair; members: cluster, block, class_id, shingles, dealt and sorted by (cluster, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def search() -> Iterator[pa.RecordBatch]:
            forest = links(sets, percent) if len(sets) > 1 else []
            if forest:
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in forest], pa.int64()), pa.array([ids[y] for _, y in forest], pa.int64())], names=["a", "b"])

        for b in batches:
            for c, k, i, s in zip(*(b.column(x).to_pylist() for x in ("cluster", "block", "class_id", "shingles")), strict=True):
                if (c, k) != key:
                    yield from search()
                    key, ids, sets = (c, k), [], []
                ids.append(i)
                sets.append(np.frombuffer(s, dtype=np.uint64))
        yield from search()

    return map_batches(members, run, "a long, b long")


def class_sets(rows: DataFrame, clustered: DataFrame, width: int) -> DataFrame:
    """cluster, class_id, shingles: the whole sets of the classes in `clustered`, from the texts of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets: list[bytes] = [b""] * part.num_rows
                for i, h in hashes_of(_texts(part), SPACED):
                    sets[i] = shingle_set(h, width).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("class_id"), pa.array(sets, pa.binary())], names=["cluster", "class_id", "shingles"])

    few = clustered.count() <= BROADCAST_CLASSES
    texts = rows.select(F.col(ROW).alias("class_id"), "text").join(F.broadcast(clustered) if few else clustered, "class_id")
    return map_batches(texts.select("cluster", "class_id", "text"), run, "cluster long, class_id long, shingles binary")


def row_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """the row, n_shingles, component: the least key of each row's group, where the key tells all rows apart."""
    spark = rows.sparkSession
    marked = cut(signatures(rows, width, percent))
    classes = cut(marked.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(ROW).alias("class_id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    buckets = classes.select("class_id", F.explode("bands").alias("bucket"))
    leads = buckets.groupBy("bucket").agg(F.min("class_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = buckets.join(leads, "bucket").filter("class_id <> lead").select(F.col("class_id").alias("a"), F.col("lead").alias("b")).distinct()
    loose = components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))
    clustered = cut(loose.join(classes.select("class_id", "n_shingles"), "class_id"))
    total = clustered.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    blocks = clustered.join(total, "cluster").select("cluster", "class_id", "n_shingles", F.when(F.col("total") > BLOCK, F.ceil(F.col("total") / (BLOCK // 2))).otherwise(1).cast("int").alias("n_blocks"))
    sets = class_sets(rows, clustered.select("class_id", "cluster"), width)
    home = F.pmod(F.xxhash64("class_id"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.least(j, home).cast("long") * 1_000_000 + F.greatest(j, home))
    placed = sets.join(blocks.select("class_id", "n_blocks"), "class_id").select("cluster", F.explode(pairs).alias("block"), "class_id", "shingles")
    held = blocks.agg(F.sum(F.col("n_shingles") * F.col("n_blocks"))).first()[0] or 0  # a set goes to each of its cluster's blocks
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.ceil(held / PER_TASK))
    forest = cluster_links(placed.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block"), percent)
    grouped = components(forest)
    named = classes.select("digest", "class_id").join(grouped, F.col("class_id") == F.col("node"), "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    return marked.select(ROW, "n_shingles", "digest").join(named, "digest", "left").select(ROW, "n_shingles", F.coalesce("component", ROW).alias("component"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of its group), kept (it is that document)."""
    rows, same = keyed(docs)
    found = row_groups(rows, width, percent)
    if same:
        found = found.select(F.col(ROW).alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        found = cut(found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW))
        least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        found = found.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the least doc_id. Where doc_ids are null or repeated, rows are told apart by their order as written, and the first stays. Texts without words stay all."""
    rows, _ = keyed(docs)
    return without(rows, row_groups(rows, width, percent).filter(F.col(ROW) != F.col("component")), ROW).select(docs.columns)
