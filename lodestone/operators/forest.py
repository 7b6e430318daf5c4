"""Classification trees on all rows of a table, level by level: a job counts the histograms of all nodes of all trees of a level; only splits reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.portable import portable_hash_numpy

#: Bins of a feature. Up to so many distinct values, every midpoint between two of them is tried; of more, quantiles.
BINS = 256
#: Cells of histograms that a task holds at once; a level with more of them takes several jobs.
CELLS = 1 << 22
#: Rows of all open nodes together up to which the rest of the trees is grown node by node, each in one task; and those of one node.
FINISH_ROWS, NODE_ROWS = 20_000_000, 500_000
#: Rows that are looked at together.
ROWS = 1 << 16
#: Levels below the root at most: nodes are numbered as in a heap, by 64 bits.
MAX_DEPTH = 60


class Spec(NamedTuple):
    """What tells a tree from the others: its number, the seed of its draws, and the fold whose rows it doesn't see (-1: it sees all)."""

    tree: int
    seed: int
    without: int = -1


class Rules(NamedTuple):
    """How trees are grown: features is the number of those tried in a node, bootstrap the mean number of times that a row is drawn (None: once)."""

    classes: int
    columns: int
    max_depth: int
    min_leaf: int
    features: int
    bootstrap: float | None


class Node(NamedTuple):
    """feature -1: a leaf. `at` is the last bin that goes left, upto the first of the node's bins that goes right, gain the fall of gini, n the drawn rows, label the most frequent class, of ties the first."""

    feature: int
    at: int
    upto: int
    gain: float
    n: int
    label: int


def poisson_steps(mean: float) -> list[int]:
    """A row whose hash is at or above k of these is drawn k times: the distribution of draws with replacement from many rows."""
    steps, total, k = [], 0.0, 0
    while len(steps) < 20 and total < 1 - 1e-9:
        total += math.exp(-mean) * mean**k / math.factorial(k)
        steps.append(min(1 << 31, round(total * (1 << 31))))
        k += 1
    return steps


def draws(keys: np.ndarray, seed: int, mean: float | None) -> np.ndarray:
    """How often each row is drawn, by its key alone, so that a repeated task draws the same."""
    if mean is None:
        return np.ones(len(keys), dtype=np.int64)
    return np.searchsorted(poisson_steps(mean), portable_hash_numpy(keys, seed), side="right")


def tree_seed(seed: int, tree: int) -> int:
    """Seeds of a forest's trees lie far apart."""
    return (seed + 7919 * (tree + 1)) % (1 << 31)


def tried(spec: Spec, heap: int, rules: Rules) -> np.ndarray:
    """The features that are tried in a node, in order."""
    if rules.features >= rules.columns:
        return np.arange(rules.columns)
    draw = np.random.default_rng(np.random.SeedSequence([spec.seed, heap]))
    return np.sort(draw.choice(rules.columns, rules.features, replace=False))


#: The first fields of a leaf.
NO_SPLIT = (-1, 0, 0, 0.0)


class Bins(NamedTuple):
    """A column's bins: the upper ends of all but the last (values themselves), and, where every value has a bin of its own, these values."""

    edges: np.ndarray
    values: np.ndarray | None

    def threshold(self, at: int, upto: int) -> float:
        """What parts the bins up to `at` from those from `upto` on, between which a node has none: the midpoint of two values, or the end of a bin."""
        if self.values is None:
            return float(self.edges[at])
        low, high = float(self.values[at]), float(self.values[min(upto, len(self.values) - 1)])
        mid = low + (high - low) / 2 if np.isfinite(high - low) else low
        return mid if low <= mid < high else low


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[Bins]:
    """For every column: a bin for each value where there are no more than `bins` (and one more for null and NaN), otherwise quantiles, by mergeable summaries."""
    found: list[Bins] = []
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    shares = [(k + 1) / bins for k in range(bins - 1)]
    measures = [m for k, v in enumerate(x) for m in (F.approx_count_distinct(v).alias(f"n{k}"), F.percentile_approx(v, shares, 10_000).alias(f"q{k}"))]
    seen = df.agg(*measures).first()
    few = [k for k in range(len(columns)) if seen[f"n{k}"] <= 1.25 * bins]
    values: dict[int, set[float]] = {k: set() for k in few}
    if few:
        every = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("at"), x[k].alias("x")) for k in few)))).filter("x IS NOT NULL").distinct()
        for r in every.collect():  # approximate counts say that there are few
            values[r.at].add(r.x + 0.0)
    for k in range(len(columns)):
        if k in values and len(values[k]) < bins:
            v = np.array(sorted(values[k]))
            found.append(Bins(v, v))
        else:
            found.append(Bins(np.unique(np.array(seen[f"q{k}"] or [], dtype=float)), None))
    return found


def binned(df: DataFrame, columns: Sequence[str], label: str, bins: list[Bins], classes: int, key: Column | None = None, fold: Column | None = None) -> DataFrame:
    """key, fold, label and bins (a byte per column), written once. Rows without a label stay out, one that isn't from 0 to classes - 1 raises; null keys count as 0; null and NaN values lie in a bin beyond all others. Without a key, rows are numbered."""
    known = F.when(F.col(label).between(0, classes - 1), F.col(label).cast("int")).otherwise(F.raise_error(F.lit(f"labels must be from 0 to {classes - 1}")).cast("int"))
    rows = df.filter(F.col(label).isNotNull()).select(F.coalesce(key if key is not None else F.monotonically_increasing_id(), F.lit(0)).cast("long").alias("key"), (fold if fold is not None else F.lit(-1)).cast("int").alias("fold"), known.alias("label"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.searchsorted(e.edges, b.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float) + 0.0, side="left") for k, e in enumerate(bins)], axis=1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("fold"), b.column("label"), packed], ["key", "fold", "label", "bins"])

    return cut(rows.mapInArrow(task, "key long, fold int, label int, bins binary"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def best_cut(histogram: np.ndarray) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, last bin that goes left, the next bin that isn't empty, class counts to the left) of counts by bin and class; of equal gains the first bin."""
    left = histogram.cumsum(axis=0)[:-1].astype(float)
    total = histogram.sum(axis=0).astype(float)
    right = total - left
    n, nl, nr = total.sum(), left.sum(axis=1), right.sum(axis=1)
    ok = (nl > 0) & (nr > 0) & (histogram[:-1].sum(axis=1) > 0)
    if not ok.any():
        return None
    with np.errstate(all="ignore"):
        gain = ((left**2).sum(axis=1) / nl + (right**2).sum(axis=1) / nr) / n - (total**2).sum() / (n * n)
    gain = np.round(np.where(ok, gain, -1.0), 12)
    at = int(gain.argmax())
    upto = at + 1 + int((histogram[at + 1 :].sum(axis=1) > 0).argmax())
    return (float(gain[at]), at, upto, left[at].astype(np.int64)) if gain[at] > 0 else None


def stays_whole(counts: np.ndarray, depth: int, rules: Rules) -> bool:
    n = int(counts.sum())
    return depth >= rules.max_depth or n <= rules.min_leaf or int(counts.max(initial=0)) == n


def _grow_here(spec: Spec, heap: int, rules: Rules, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, Node]]:
    """(heap number, node) of a node and all below it, of its drawn rows."""
    left = [(heap, np.arange(len(y)))]
    while left:
        at, rows = left.pop()
        counts = np.bincount(y[rows], w[rows], rules.classes).astype(np.int64)
        best: tuple[int, int, int, float] | None = None
        if not stays_whole(counts, at.bit_length() - 1, rules):
            for f in tried(spec, at, rules).tolist():
                cells = np.bincount(x[rows, f].astype(np.int64) * rules.classes + y[rows], w[rows], BINS * rules.classes)
                found = best_cut(cells.reshape(BINS, rules.classes).astype(np.int64))
                if found and (best is None or found[0] > best[3]):
                    best = (f, found[1], found[2], found[0])
        yield at, Node(*(best or NO_SPLIT), int(counts.sum()), int(counts.argmax()))
        if best is not None:
            goes = x[rows, best[0]] <= best[1]
            left += [(2 * at + 1, rows[~goes]), (2 * at, rows[goes])]


class Table(NamedTuple):
    """A tree as arrays: feature (-1: leaf), bin, left, right by place; and the heap numbers of the places."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    heap: np.ndarray

    @staticmethod
    def of(nodes: dict[int, Node], open_nodes: Sequence[int] = ()) -> Table:
        heaps = sorted({*nodes, *open_nodes})
        place = {h: k for k, h in enumerate(heaps)}
        inner = [nodes.get(h) for h in heaps]
        split = [n is not None and n.feature >= 0 for n in inner]
        child = lambda side: np.array([place[2 * h + side] if s else 0 for h, s in zip(heaps, split, strict=True)], dtype=np.int64)
        return Table(np.array([n.feature if s else -1 for n, s in zip(inner, split, strict=True)], dtype=np.int64), np.array([n.at if s else 0 for n, s in zip(inner, split, strict=True)], dtype=np.int64), child(0), child(1), np.array(heaps, dtype=np.int64))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The place at which every row of bins comes to rest."""
        at, going = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(going):
            f = self.feature[at[going]]
            going, f = going[f >= 0], f[f >= 0]
            here = at[going]
            at[going] = np.where(x[going, f] <= self.at[here], self.left[here], self.right[here])
        return at


def _rows_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            b = whole.slice(start, ROWS)
            yield b.column("key").to_numpy(), b.column("fold").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("bins"), columns)


def _drawn(spec: Spec, rules: Rules, key: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tree has drawn, and how often."""
    w = draws(key, spec.seed, rules.bootstrap)
    if spec.without >= 0:
        w = np.where(fold == spec.without, 0, w)
    rows = np.flatnonzero(w)
    return rows, w[rows]


class _Open(NamedTuple):
    """A node that may still be split, and its class counts."""

    spec: Spec
    heap: int
    counts: np.ndarray | None  # None: a root, whose rows aren't counted yet


def _cells(rows: DataFrame, slots: list[_Open], tables: dict[int, Table], rules: Rules) -> DataFrame:
    """sf (slot * features + place of the feature tried), cell (bin * classes + class), n: what the drawn rows of the slots' nodes count up to, per task."""
    per = rules.features * BINS * rules.classes
    by_tree: dict[int, list[int]] = {}
    for k, o in enumerate(slots):
        by_tree.setdefault(o.spec.tree, []).append(k)
    plan = []
    for tree, own in by_tree.items():
        table = tables[tree]
        place = {int(h): k for k, h in enumerate(table.heap)}
        slot_of = np.full(len(table.heap), -1, dtype=np.int64)
        for j, k in enumerate(own):
            slot_of[place[slots[k].heap]] = j
        features = np.stack([tried(slots[k].spec, slots[k].heap, rules) for k in own])
        plan.append((slots[own[0]].spec, table, own[0], len(own), slot_of, features))  # a tree's slots follow each other
    held = rows.sparkSession.sparkContext.broadcast(plan)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(count * per) for _, _, _, count, _, _ in held.value]
        for key, fold, y, x in _rows_of(batches, rules.columns):
            for place, (spec, table, _, _, slot_of, features) in enumerate(held.value):
                at, w = _drawn(spec, rules, key, fold)
                slot = slot_of[table.leaf(x[at])]
                at, w, slot = at[slot >= 0], w[slot >= 0], slot[slot >= 0]
                for j in range(rules.features):
                    cell = ((slot * rules.features + j) * BINS + x[at, features[slot, j]]) * rules.classes + y[at]
                    total[place] += np.bincount(cell, w, len(total[place]))
        for (_, _, first, _, _, _), t in zip(held.value, total, strict=True):
            used = np.flatnonzero(t)
            sf, cell = np.divmod(used, BINS * rules.classes)
            yield pa.RecordBatch.from_arrays([pa.array(sf + first * rules.features), pa.array(cell.astype(np.int32)), pa.array(t[used].astype(np.int64))], ["sf", "cell", "n"])

    return rows.mapInArrow(task, "sf long, cell int, n long")


def _splits(cells: DataFrame, rules: Rules) -> DataFrame:
    """sf, gain, at, upto, goes_left, counts: the best cut of every node and feature tried (gain 0: none), from the sums over all tasks. A task has counted a cell once, so the only shuffle is by sf."""
    size = BINS * rules.classes

    def best(group: pa.Table) -> pa.Table:
        h = np.zeros(size, dtype=np.int64)
        h[group.column("cell").to_numpy()] = group.column("n").to_numpy()
        h = h.reshape(BINS, rules.classes)
        gain, at, upto, left = best_cut(h) or (0.0, 0, 0, np.zeros(rules.classes, dtype=np.int64))
        longs = pa.list_(pa.int64())
        return pa.table([group.column("sf").slice(0, 1), pa.array([gain]), pa.array([at], pa.int32()), pa.array([upto], pa.int32()), pa.array([left], longs), pa.array([h.sum(axis=0)], longs)], ["sf", "gain", "at", "upto", "goes_left", "counts"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = cells.repartition(parts, "sf").groupBy("sf", "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy("sf").applyInArrow(best, "sf long, gain double, at int, upto int, goes_left array<long>, counts array<long>")


def _finish(rows: DataFrame, slots: list[_Open], tables: dict[int, Table], rules: Rules) -> DataFrame:
    """tree, heap and the node's fields of all nodes in and below the slots', whose rows meet in one task each."""
    by_tree: dict[int, list[int]] = {}
    for k, o in enumerate(slots):
        by_tree.setdefault(o.spec.tree, []).append(k)
    plan = []
    for tree, own in by_tree.items():
        place = {int(h): k for k, h in enumerate(tables[tree].heap)}
        slot_of = np.full(len(place), -1, dtype=np.int64)
        for k in own:
            slot_of[place[slots[k].heap]] = k
        plan.append((slots[own[0]].spec, tables[tree], slot_of))
    held = rows.sparkSession.sparkContext.broadcast((plan, [(o.spec, o.heap) for o in slots]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fold, y, x in _rows_of(batches, rules.columns):
            for spec, table, slot_of in held.value[0]:
                at, w = _drawn(spec, rules, key, fold)
                slot = slot_of[table.leaf(x[at])]
                at, w, slot = at[slot >= 0], w[slot >= 0], slot[slot >= 0]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rules.columns), len(at), [None, pa.py_buffer(x[at].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(y[at].astype(np.int32)), pa.array(w.astype(np.int32)), packed], ["slot", "label", "w", "bins"])

    def grow(group: pa.Table) -> pa.Table:
        spec, heap = held.value[1][group.column("slot")[0].as_py()]
        x = np.concatenate([_matrix(c, rules.columns) for c in group.column("bins").chunks])
        found = list(_grow_here(spec, heap, rules, x, group.column("label").to_numpy(), group.column("w").to_numpy()))
        return pa.table({"tree": pa.array([spec.tree] * len(found), pa.int32()), "heap": pa.array([h for h, _ in found], pa.int64()), **{k: pa.array([getattr(n, k) for _, n in found], t) for k, t in (("feature", pa.int32()), ("at", pa.int32()), ("upto", pa.int32()), ("gain", pa.float64()), ("n", pa.int64()), ("label", pa.int32()))}})

    return rows.mapInArrow(deal, "slot long, label int, w int, bins binary").groupBy("slot").applyInArrow(grow, "tree int, heap long, feature int, at int, upto int, gain double, n long, label int")


def grow(rows: DataFrame, specs: Sequence[Spec], rules: Rules, n_rows: int | None = None) -> list[dict[int, Node]]:
    """The nodes of every tree by heap number (root 1, children 2h and 2h + 1), from binned rows.

    The driver holds the trees; rows find their node by walking down the tree, which is broadcast. A lost task is simply run again."""
    if rules.max_depth > MAX_DEPTH:
        raise ValueError(f"trees of more than {MAX_DEPTH} levels")
    n_rows = rows.count() if n_rows is None else n_rows
    nodes: dict[int, dict[int, Node]] = {s.tree: {} for s in specs}
    level = [_Open(s, 1, None) for s in specs]
    per, share = rules.features * BINS * rules.classes, 1.0 if rules.bootstrap is None else rules.bootstrap
    size = lambda o: n_rows * share if o.counts is None else int(o.counts.sum())
    while level:
        open_of: dict[int, list[int]] = {}
        for o in level:
            open_of.setdefault(o.spec.tree, []).append(o.heap)
        tables = {t: Table.of(nodes[t], h) for t, h in open_of.items()}
        if sum(map(size, level)) <= FINISH_ROWS and max(map(size, level)) <= NODE_ROWS:
            for r in _finish(rows, level, tables, rules).collect():
                nodes[r.tree][r.heap] = Node(r.feature, r.at, r.upto, r.gain, r.n, r.label)
            for o in level:  # a tree that drew no row
                nodes[o.spec.tree].setdefault(o.heap, Node(*NO_SPLIT, 0, 0))
            break
        below: list[_Open] = []
        step = max(1, CELLS // per)
        for start in range(0, len(level), step):
            group = level[start : start + step]
            found: dict[int, list] = {}
            for r in _splits(_cells(rows, group, tables, rules), rules).collect():
                found.setdefault(r.sf // rules.features, []).append(r)
            for k, o in enumerate(group):
                mine = sorted(found.get(k, ()), key=lambda r: (-r.gain, r.sf))
                counts = np.array(mine[0].counts, dtype=np.int64) if mine else np.zeros(rules.classes, dtype=np.int64)
                depth = o.heap.bit_length() - 1
                if not mine or mine[0].gain <= 0 or stays_whole(counts, depth, rules):
                    nodes[o.spec.tree][o.heap] = Node(*NO_SPLIT, int(counts.sum()), int(counts.argmax()))
                    continue
                best, features = mine[0], tried(o.spec, o.heap, rules)
                nodes[o.spec.tree][o.heap] = Node(int(features[best.sf % rules.features]), best.at, best.upto, best.gain, int(counts.sum()), int(counts.argmax()))
                left = np.array(best.goes_left, dtype=np.int64)
                for heap, c in ((2 * o.heap, left), (2 * o.heap + 1, counts - left)):
                    if stays_whole(c, depth + 1, rules):
                        nodes[o.spec.tree][heap] = Node(*NO_SPLIT, int(c.sum()), int(c.argmax()))
                    else:
                        below.append(_Open(o.spec, heap, c))
        level = below
    return [nodes[s.tree] for s in specs]


class FittedTree(NamedTuple):
    """A tree over values: feature (-1: leaf), threshold (x <= threshold goes left), left, right, label by place."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, going = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(going):
            f = self.feature[at[going]]
            going, f = going[f >= 0], f[f >= 0]
            here = at[going]
            at[going] = np.where(x[going, f] <= self.threshold[here], self.left[here], self.right[here])
        return self.label[at]


def fitted(nodes: dict[int, Node], bins: list[Bins]) -> FittedTree:
    t = Table.of(nodes)
    inner = [nodes[int(h)] for h in t.heap]
    return FittedTree(t.feature, np.array([bins[n.feature].threshold(n.at, n.upto) if n.feature >= 0 else 0.0 for n in inner]), t.left, t.right, np.array([n.label for n in inner], dtype=np.int64))


def importances(trees: Sequence[dict[int, Node]], columns: int) -> np.ndarray:
    """Shares of the features in the fall of gini, weighted by the rows that reach a node; all 0 if no tree has a split."""
    total = np.zeros(columns)
    for nodes in trees:
        whole = nodes[1].n
        for n in nodes.values():
            if n.feature >= 0:
                total[n.feature] += n.n / whole * n.gain
    return total / total.sum() if total.sum() else total


def vote(df: DataFrame, keep: Sequence[str], columns: Sequence[str], trees: list[tuple[int, FittedTree]], classes: int, fold: str | None = None) -> DataFrame:
    """The kept columns, y_pred (most votes, of ties the first class) and probabilities (shares of votes). With a fold column, a row is judged by the trees that didn't see its fold."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", y_pred long, probabilities array<double>"
    held = df.sparkSession.sparkContext.broadcast(trees)
    names = [f"_x{k}" for k in range(len(columns))]
    asked = df.select(*keep, (F.lit(-1) if fold is None else F.col(fold)).cast("int").alias("_fold"), *(F.col(c).cast("double").alias(n) for n, c in zip(names, columns, strict=True)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)
            own, votes = b.column("_fold").to_numpy(), np.zeros((len(x), classes))
            for without, tree in held.value:
                at = np.flatnonzero(own == without)
                if len(at):
                    votes[at, tree.predict(x[at])] += 1
            total = np.maximum(votes.sum(axis=1, keepdims=True), 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(votes.argmax(axis=1)), pa.array(list(votes / total), pa.list_(pa.float64()))], [*keep, "y_pred", "probabilities"])

    return asked.mapInArrow(task, schema)


def saved(spark: SparkSession, trees: Sequence[dict[int, Node]]) -> DataFrame:
    """The nodes of a forest as rows: tree, heap, feature, at, upto, gain, n, label."""
    rows = [(t, h, *n) for t, nodes in enumerate(trees) for h, n in nodes.items()]
    return spark.createDataFrame(rows, "tree int, heap long, feature int, at int, upto int, gain double, n long, label int")


def loaded(rows: DataFrame) -> list[dict[int, Node]]:
    trees: dict[int, dict[int, Node]] = {}
    for r in rows.collect():
        trees.setdefault(r.tree, {})[r.heap] = Node(r.feature, r.at, r.upto, r.gain, r.n, r.label)
    return [trees[t] for t in sorted(trees)]
