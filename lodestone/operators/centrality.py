"""Betweenness: parts of a graph that a task can hold are walked there, source by source; in larger ones blocks of sources go level by level, a row holding a vertex's path counts for all sources of the block that reach it at one level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut, cut_and_observe, written
from lodestone.llm.components import components
from lodestone.sources.graphs import Graph

#: Sources that are walked from together. The memory that a row takes follows this, not the number of sources.
BLOCK = 1024
#: What rows are multiplied by in codes of a row and a source.
STRIDE = 1 << 15
#: Arcs and vertices up to which a graph is broadcast (some 60 MB), and a connected part of a larger one is held by a task.
BROADCAST_ARCS = 4_000_000
#: Arcs up to which connected parts share a bin, and how many arcs a bin has of them on average.
PACKED_ARCS = 100_000
#: How many arcs a task passes over (some 10 s), unless its sources would be fewer than SHARE.
WALKED_ARCS, SHARE = 200_000_000, 1024
#: Into how many tasks at most all of that is dealt.
MOST_TASKS = 10_000
#: Pairs of a vertex and a source at a level up to which the level is broadcast to the arcs (60 MB at most).
BROADCAST_PAIRS = 500_000

_SHORTS, _DOUBLES = pa.list_(pa.int16()), pa.list_(pa.float64())
Flat = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, source within the block, value


def _flat(batch: pa.RecordBatch, keys: str, values: str | None = None) -> Flat:
    """The lists of a column (and of one as long beside it) laid end to end."""
    k = batch.column(keys)
    rows = np.repeat(np.arange(len(k)), np.diff(np.asarray(k.offsets))) if not k.null_count else np.repeat(np.arange(len(k)), [len(x) if x is not None else 0 for x in k.to_pylist()])
    v = batch.column(values).flatten().to_numpy() if values else np.zeros(len(rows))
    return rows, k.flatten().to_numpy().astype(np.int64), v


def _summed(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(code, return_inverse=True)
    return found, np.bincount(at, value, len(found))


def _lists(code: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.Array]:
    """Ordered codes (row * STRIDE + source) as a list of sources per row, and values in lists alike."""
    row, k = np.divmod(code, STRIDE)
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(k.astype(np.int16))), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, k, s: sums by vertex and source, before they are sent."""
    for b in batches:
        v, at = np.unique(b.column("v").to_numpy(), return_inverse=True)
        row, k, s = _flat(b, "k", "s")
        code, total = _summed(at[row] * STRIDE + k, s)
        yield pa.RecordBatch.from_arrays([pa.array(v), *_lists(code, len(v), total)], ["v", "k", "s"])


def _advance(directed: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What came in less the sources that have been at a vertex already becomes its new level."""
        for b in batches:
            row, k, s = _flat(b, "came", "sums")
            code, total = _summed(row * STRIDE + k, s)
            seen, now = ((r * STRIDE + q) for r, q, _ in (_flat(b, "seen"), _flat(b, "k")))
            fresh = ~np.isin(code, np.concatenate((seen, now)))
            # without direction a level's neighbours lie at most one level off, so only the last level must be remembered
            (past,) = _lists(np.unique(np.concatenate((seen, now)) if directed else now), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("v"), past, *_lists(code[fresh], b.num_rows, total[fresh])], ["v", "seen", "k", "s"])

    return run


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """delta of a level's sources: sigma times what the next level sends; 0 where it sends nothing."""
    for b in batches:
        row, k, s = _flat(b, "k", "s")
        code = row * STRIDE + k
        order = np.argsort(code)
        code, s = code[order], s[order]
        in_row, in_k, x = _flat(b, "came", "sums")
        got, total = _summed(in_row * STRIDE + in_k, x)
        at = np.searchsorted(got, code)
        at[at == len(got)] = 0
        delta = np.where(got[at] == code, total[at], 0.0) * s if len(got) else np.zeros(len(code))
        sums = np.bincount(code // STRIDE, delta, b.num_rows)
        k_list, back = _lists(code, b.num_rows, (1 + delta) / s)
        yield pa.RecordBatch.from_arrays([b.column("v"), k_list, back, pa.array(sums)], ["v", "k", "s", "raw"])


_MESSAGE = "v long, k array<short>, s array<double>"


def _sent(arcs: DataFrame, level: DataFrame, pairs: int, parts: int) -> DataFrame:
    """v, came, sums: along all arcs (at, to) from a level's vertices; summed per batch, then gathered at the targets. pairs: how many sources the level's vertices have between them."""
    given = level.filter(F.size("k") > 0).select(F.col("v").alias("at"), "k", "s")
    along = arcs.join(F.broadcast(given) if pairs <= BROADCAST_PAIRS else given.hint("merge"), "at").select(F.col("to").alias("v"), "k", "s")
    return along.mapInArrow(_combine, _MESSAGE).repartition(parts, "v").groupBy("v").agg(F.flatten(F.collect_list("k")).alias("came"), F.flatten(F.collect_list("s")).alias("sums"))


def dependencies(arcs: DataFrame, back: DataFrame, sources: DataFrame, directed: bool, parts: int) -> DataFrame:
    """v, raw: the sum over sources (v, k from 0 to BLOCK - 1) of how much their shortest paths depend on v. arcs and back are (at, to), dealt out by `at` over `parts` and in its order: forward and reversed.

    A level is a job, forward and back; levels lie in the shared folder."""
    none = F.array().cast("array<short>")
    state = cut(sources.select("v", none.alias("seen"), F.array(F.col("k").cast("short")).alias("k"), F.array(F.lit(1.0)).alias("s")).repartition(parts, "v"))
    levels, pairs = [state], [BLOCK]
    while True:
        joined = state.join(_sent(arcs, state, pairs[-1], parts).withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "full").select(F.coalesce("v", "_v").alias("v"), *(F.coalesce(c, none).alias(c) for c in ("seen", "k", "came")), F.coalesce("sums", F.array().cast("array<double>")).alias("sums"))
        ahead = joined.mapInArrow(_advance(directed), "v long, seen array<short>, k array<short>, s array<double>").filter((F.size("k") > 0) | (F.size("seen") > 0))
        state, found = cut_and_observe(ahead, n=F.sum(F.size("k")))
        if not found["n"]:
            break
        levels.append(state)
        pairs.append(found["n"])
    rows = [x.filter(F.size("k") > 0).select("v", "k", "s") for x in levels]
    behind = rows[-1].withColumn("s", F.transform("s", lambda x: 1 / x))
    total = rows[0].select("v", F.lit(0.0).alias("raw"))
    for level, sent in reversed(list(zip(rows[1:-1], pairs[2:], strict=True))):
        came = _sent(back, behind, sent, parts).withColumnRenamed("v", "_v")
        joined = level.join(came, F.col("v") == F.col("_v"), "left").select("v", "k", "s", F.coalesce("came", none).alias("came"), F.coalesce("sums", F.array().cast("array<double>")).alias("sums"))
        behind = cut(joined.mapInArrow(_return, f"{_MESSAGE}, raw double"))
        total = total.unionByName(behind.select("v", "raw"))
    return cut(total.groupBy("v").agg(F.sum("raw").alias("raw")))


class Held:
    """A graph that a task holds. first: where a vertex's arcs begin in `to`. total: what all walks so far found. A walk wipes only what it wrote, and takes time by the part of the graph that it sees, not by the whole."""

    def __init__(self, first: np.ndarray, to: np.ndarray) -> None:
        self.n, self.first, self.to, self.deg = len(first) - 1, first.copy(), to.astype(np.int64), np.diff(first)
        self.at = np.repeat(np.arange(self.n), self.deg)
        self.sigma, self.delta, self.total = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        self.unseen, self.now, self.slot = np.ones(self.n, dtype=bool), np.zeros(self.n, dtype=bool), np.zeros(self.n, dtype=np.int64)

    def _ahead(self, frontier: np.ndarray) -> np.ndarray:
        """The arcs from a level to vertices not seen before. Where the level has many, all arcs are looked through, which is less than to gather its own."""
        k = self.deg[frontier]
        n = int(k.sum())
        if 8 * n > len(self.to):
            self.now[frontier] = True
            arcs = np.flatnonzero(self.now.take(self.at) & self.unseen.take(self.to))
            self.now[frontier] = False
            return arcs
        arcs = np.arange(n) + np.repeat(self.first[frontier] - np.cumsum(k) + k, k)
        return arcs[self.unseen.take(self.to.take(arcs))]

    def walk(self, source: int) -> None:
        """Adds to total how much the shortest paths from a source depend on every vertex."""
        sigma, delta = self.sigma, self.delta
        frontier = np.array([source])
        sigma[source], self.unseen[source] = 1.0, False
        levels, steps = [frontier], []
        while len(arcs := self._ahead(frontier)):
            at, ahead = self.at.take(arcs), self.to.take(arcs)
            if 8 * len(arcs) > self.n:
                sums = np.bincount(ahead, sigma.take(at), self.n)
                frontier = np.flatnonzero(sums)
                sigma[frontier] = sums[frontier]
            else:
                place = np.arange(len(ahead))
                self.slot[ahead] = place
                frontier = ahead[self.slot.take(ahead) == place]
                np.add.at(sigma, ahead, sigma.take(at))
            self.unseen[frontier] = False
            levels.append(frontier)
            steps.append((at, ahead))
        for k in range(len(steps), 0, -1):
            (at, ahead), level, before = steps[k - 1], levels[k], levels[k - 1]
            found = delta[level]
            self.total[level] += found
            delta[level] = (1 + found) / sigma[level]
            if 8 * len(at) > self.n:
                delta[before] = np.bincount(at, delta.take(ahead), self.n)[before]
            else:
                np.add.at(delta, at, delta.take(ahead))
            delta[before] *= sigma[before]
        for level in levels:
            sigma[level], delta[level], self.unseen[level] = 0.0, 0.0, True


def _tasks(n_sources: int, walked: int) -> int:
    """Over how many tasks sources are dealt that pass over so many arcs."""
    return max(1, min(-(-n_sources // SHARE), walked // WALKED_ARCS))


def from_every_source(g: Graph, n: int, sources: DataFrame, n_sources: int) -> DataFrame:
    """v, raw over a graph that a task can hold: its arcs are broadcast, the sources are dealt out."""
    spark = g.vertices.sparkSession
    arcs = g.arcs.filter("src <> dst").select("src", "dst").toArrow()
    src, dst = (arcs.column(c).to_numpy() for c in ("src", "dst"))
    first = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))
    held = spark.sparkContext.broadcast((first, dst[np.argsort(src, kind="stable")].astype(np.int32)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Held(*held.value)
        for b in batches:
            for v in b.column("v").to_pylist():
                graph.walk(v)
        at = np.flatnonzero(graph.total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(graph.total[at])], ["v", "raw"])

    parts = max(1, min(n_sources, max(2 * spark.sparkContext.defaultParallelism, _tasks(n_sources, n_sources * len(src)))))
    return sources.select("v").repartition(parts, "v").mapInArrow(task, "v long, raw double").groupBy("v").agg(F.sum("raw").alias("raw"))


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The arcs (a, b) of a bin and its sources (a alone) as one row; tasks: over how many its sources are to be dealt."""
    part, a, source = rows.column("component").to_numpy(), rows.column("a").to_numpy(), rows.column("b").is_null().to_numpy()
    src, dst = a[~source], rows.column("b").drop_null().to_numpy()
    vertices, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(np.bincount(at[: len(src)], minlength=len(vertices)))))
    to = at[len(src) :][np.argsort(at[: len(src)], kind="stable")]
    names, sizes = np.unique(part[~source], return_counts=True)
    walked = int(sizes[np.searchsorted(names, part[source])].sum())
    columns = [vertices, first, to.astype(np.int32), np.searchsorted(vertices, a[source]).astype(np.int32)]
    tasks = _tasks(len(columns[-1]), walked) if source.any() else 0
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([tasks], pa.int64())], _PACKED_NAMES)


_PACKED = "bin long, vertices binary, first binary, to binary, sources binary, tasks long"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, raw by a task's share of the sources of a bin."""
    for b in batches:
        for r in range(b.num_rows):
            vertices, first, to, sources = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in zip(_PACKED_NAMES[1:5], (np.int64, np.int64, np.int32, np.int32), strict=True))
            graph = Held(first, to)
            for v in sources[b.column("task")[r].as_py() :: b.column("tasks")[r].as_py()].tolist():
                graph.walk(v)
            at = np.flatnonzero(graph.total)
            yield pa.RecordBatch.from_arrays([pa.array(vertices[at]), pa.array(graph.total[at])], ["v", "raw"])


def by_component(g: Graph, sources: DataFrame) -> DataFrame:
    """v, raw: no path leaves a connected part. Parts of up to BROADCAST_ARCS arcs are packed into a row each, small ones by bins, which is sent to as many tasks as its sources take; in larger parts blocks of sources go after one another."""
    from lodestone.operators.graph import global_rank  # noqa: PLC0415

    arcs = g.arcs.filter("src <> dst").select("src", "dst")
    members = cut(components((arcs if g.directed else arcs.filter("src < dst")).toDF("a", "b")))
    placed = written(arcs.join(members, F.col("src") == F.col("node")).select("component", F.col("src").alias("a"), F.col("dst").alias("b")))
    mine = written(sources.select("v").join(members, F.col("v") == F.col("node")).select("component", F.col("v").alias("a"), F.lit(None).cast("long").alias("b")))
    sizes = cut(placed.groupBy("component").agg(F.count("*").alias("size")))
    least = min(PACKED_ARCS, BROADCAST_ARCS)
    big, small = sizes.filter(F.col("size") > least), F.when(F.col("size") <= least, F.col("size"))
    seen = sizes.agg(F.coalesce(F.sum(small), F.lit(0)).alias("packed"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    bins = max(1, seen.packed // PACKED_ARCS)
    bin_of = F.when(F.col("size").isNull(), -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component"))
    rows = placed.unionByName(mine).join(F.broadcast(big), "component", "left").filter(F.col("size").isNull() | (F.col("size") <= BROADCAST_ARCS))
    packed = cut(rows.select(bin_of.alias("bin"), "component", "a", "b").groupBy("bin").applyInArrow(_packed, _PACKED)).filter("tasks > 0")
    tasks = packed.agg(F.sum("tasks")).first()[0] or 1
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")).repartition(min(tasks, MOST_TASKS), "bin", "task")
    held = cut(dealt.mapInArrow(_walked, "v long, raw double").groupBy("v").agg(F.sum("raw").alias("raw")))
    if seen.most <= BROADCAST_ARCS:
        return held
    large = F.broadcast(big.filter(F.col("size") > BROADCAST_ARCS))
    rest = global_rank(mine.join(large, "component", "left_semi").select(F.col("a").alias("v")), ["v"], "place")
    inside = placed.join(large, "component", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return held.unionByName(in_blocks(inside, g.directed, rest, rest.count()))


def in_blocks(arcs: DataFrame, directed: bool, sources: DataFrame, n_sources: int) -> DataFrame:
    """v, raw: arcs (src, dst) are dealt out and a block of sources (v, place) goes after the other."""
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forward = arcs.select(F.col("src").alias("at"), F.col("dst").alias("to")).repartition(parts, "at").sortWithinPartitions("at").persist()
    back = arcs.select(F.col("dst").alias("at"), F.col("src").alias("to")).repartition(parts, "at").sortWithinPartitions("at").persist() if directed else forward
    total: DataFrame | None = None
    try:
        for block in range(max(1, -(-n_sources // BLOCK))):
            mine = sources.filter((F.col("place") >= block * BLOCK) & (F.col("place") < (block + 1) * BLOCK)).select("v", (F.col("place") - block * BLOCK).alias("k"))
            raw = dependencies(forward, back, mine, directed, parts)
            total = raw if total is None else cut(total.unionByName(raw).groupBy("v").agg(F.sum("raw").alias("raw")))
    finally:
        forward.unpersist()
        if directed:
            back.unpersist()
    return total


def betweenness_raw(g: Graph, n: int, sources: DataFrame, n_sources: int) -> DataFrame:
    """v, raw summed over all sources (v, place). A graph of up to BROADCAST_ARCS arcs and as many vertices goes to all tasks, which share the sources; in a larger one, sources of more than a block are dealt out by connected parts, and those of a block walk it together."""
    if n <= BROADCAST_ARCS and g.arcs.count() <= BROADCAST_ARCS:
        return from_every_source(g, n, sources, n_sources)
    if n_sources > BLOCK:
        return by_component(g, sources)
    return in_blocks(g.arcs.filter("src <> dst"), g.directed, sources, n_sources)
