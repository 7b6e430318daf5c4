"""Split statistics, tree ensembles and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.operators import forest
from lodestone.operators.graph import kfold

#: Classes that `best_split` counts side by side.
MAX_CLASSES = 1000


def gini(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, gini: 1 less the sum of squared class shares."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")).cast("double")).alias("gini"))


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, label: the most frequent class, of ties the first in order."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    most = counts.groupBy(group).agg(F.max("n").alias("most"))
    return counts.join(most, group).filter("n = most").groupBy(group).agg(F.min(label).alias(label))


def best_split(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, threshold, gain of the split x <= threshold with the greatest fall of gini; ties go to the first feature, then the least threshold.

    Rows are counted per feature, value and class first. Distinct values are then dealt out by range over all features;
    class counts are summed within a range and shifted by those of the ranges before, so that no task holds a feature."""
    classes = [r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not classes:
        return df.sparkSession.createDataFrame([], "feature string, threshold double, gain double")
    places = range(len(classes))
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*(F.struct(F.lit(k).alias("at"), F.col(f).cast("double").alias("x")) for k, f in enumerate(features)))))
    n_of = [F.count_if(F.col("label").eqNullSafe(F.lit(c))).alias(f"n{k}") for k, c in enumerate(classes)]
    values = long.groupBy("at", "x").agg(*n_of)
    parts = cut(values.repartitionByRange("at", "x").withColumn("_part", F.spark_partition_id()))
    sums = [F.sum(f"n{k}").alias(f"s{k}") for k in places]
    # per range and feature: class counts and the least value; one row per range and the few features in it
    ranges = parts.groupBy("_part", "at").agg(F.min("x").alias("first"), *sums)
    over = Window.partitionBy("at").orderBy("_part")
    before = ranges.select("_part", "at", F.lead("first").over(over).alias("next"), *(F.coalesce(F.sum(f"s{k}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{k}") for k in places), *(F.sum(f"s{k}").over(Window.partitionBy("at")).alias(f"t{k}") for k in places))
    inner = Window.partitionBy("_part", "at").orderBy("x")
    upto = [(F.col(f"b{k}") + F.sum(f"n{k}").over(inner)).cast("double").alias(f"l{k}") for k in places]
    seen = parts.join(before, ["_part", "at"]).select("at", "x", F.coalesce(F.lead("x").over(inner), F.col("next")).alias("after"), *upto, *(f"t{k}" for k in places))
    total = lambda f: sum((f(k) for k in places), F.lit(0.0))
    right = lambda k: F.col(f"t{k}") - F.col(f"l{k}")
    sides = seen.select("at", ((F.col("x") + F.col("after")) / 2).alias("threshold"), total(lambda k: F.col(f"l{k}")).alias("nl"), total(right).alias("nr"), total(lambda k: F.col(f"l{k}") * F.col(f"l{k}")).alias("l2"), total(lambda k: right(k) * right(k)).alias("r2"), total(lambda k: F.col(f"t{k}") * F.col(f"t{k}")).alias("t2"))
    n = F.col("nl") + F.col("nr")
    split = sides.filter("threshold IS NOT NULL AND nr > 0").select("at", "threshold", ((F.col("l2") / F.col("nl") + F.col("r2") / F.col("nr")) / n - F.col("t2") / (n * n)).alias("gain"))
    names = F.array(*map(F.lit, features))
    return split.orderBy(F.round("gain", 12).desc(), "at", "threshold").limit(1).select(F.element_at(names, F.col("at") + 1).alias("feature"), "threshold", "gain")


def confusion(pairs: DataFrame, k: int) -> DataFrame:
    """y_true, y_pred, n over all k * k cells."""
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    grid = spark.range(k * k).select(F.floor(F.col("id") / k).alias("y_true"), (F.col("id") % k).alias("y_pred"))
    return grid.join(counts.select(F.col("y_true").cast("long").alias("y_true"), F.col("y_pred").cast("long").alias("y_pred"), "n"), ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(pairs: DataFrame, k: int) -> DataFrame:
    """class, precision, recall, f1, support; 0 where nothing is there to divide by."""
    c = confusion(pairs, k)
    sides = c.select(F.inline(F.array(F.struct(F.col("y_true").alias("class"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))))
    s = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pr = s.withColumn("precision", share(F.col("tp"), F.col("predicted"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return pr.select("class", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def macro(pairs: DataFrame, k: int) -> DataFrame:
    """One row: accuracy and the unweighted means over all k classes."""
    means = per_class(pairs, k).agg(*((F.sum(c) / k).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    right = pairs.agg(F.coalesce(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return right.join(F.broadcast(means))


def format_report(metrics: DataFrame) -> DataFrame:
    """line: the per-class table as text with four decimals."""
    return metrics.select("class", F.format_string("%d %.4f %.4f %.4f %d", "class", "precision", "recall", "f1", "support").alias("line"))


class Cart:
    """A classification tree: gini, exact midpoints, x <= threshold goes left, no split without gain. Nodes of min_leaf rows or fewer stay whole."""

    def __init__(self, max_depth: int = 10, min_leaf: int = 5, features: int | None = None, seed: int = 42) -> None:
        self.max_depth, self.min_leaf, self.features = max_depth, min_leaf, features
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple[int, float, int, int, int]] = []  # feature, threshold, left, right, class
        self.importance: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, k: int) -> Cart:
        self.k, self.n, self.importance = k, len(y), np.zeros(x.shape[1])
        self._grow(x, y, np.arange(len(y)), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int) -> int:
        counts = np.bincount(y[rows], minlength=self.k)
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(counts.argmax())))
        if depth >= self.max_depth or len(rows) <= self.min_leaf or counts.max() == len(rows):
            return me
        f = x.shape[1]
        tried = self.rng.choice(f, self.features or max(1, int(f**0.5)), replace=False)
        best = (0.0, -1, 0.0)
        whole = (counts.astype(float) ** 2).sum() / len(rows)
        for j in sorted(tried.tolist()):
            order = np.argsort(x[rows, j], kind="stable")
            v, labels = x[rows[order], j], y[rows[order]]
            left = np.cumsum(np.eye(self.k)[labels], axis=0)[:-1]
            ok = v[1:] > v[:-1]
            if not ok.any():
                continue
            nl = np.arange(1, len(v))
            gain = ((left**2).sum(1) / nl + ((counts - left) ** 2).sum(1) / (len(v) - nl) - whole) / len(v)
            gain[~ok] = -1
            at = int(gain.argmax())
            if gain[at] > best[0] + 1e-12:
                best = (float(gain[at]), j, float((v[at] + v[at + 1]) / 2))
        if best[1] < 0:
            return me
        self.importance[best[1]] += len(rows) / self.n * best[0]
        goes = x[rows, best[1]] <= best[2]
        a = self._grow(x, y, rows[goes], depth + 1)
        b = self._grow(x, y, rows[~goes], depth + 1)
        self.nodes[me] = (best[1], best[2], a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        table = np.array(self.nodes)
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.max_depth):
            node = table[at]
            inner = node[:, 0] >= 0
            if not inner.any():
                break
            f = np.maximum(node[:, 0].astype(np.int64), 0)
            at = np.where(inner, np.where(x[np.arange(len(x)), f] <= node[:, 1], node[:, 2], node[:, 3]).astype(np.int64), at)
        return table[at, 4].astype(np.int64)


class Forest:
    """Trees on bootstrap samples, grown level by level on all rows; prediction is by hard votes, of ties the lowest class.

    Every row is drawn a Poisson number of times for each tree, by a hash of its key: what draws with replacement come to in a large table."""

    def __init__(self, trees: int = 100, max_depth: int = 10, min_leaf: int = 5, bootstrap: float | None = 0.8, features: int | None = None, seed: int = 42, bins: int = forest.BINS) -> None:
        """bootstrap: how often a row is drawn for a tree on average; None gives every tree all rows. features: how many are tried in a node (None: the root of their number, rounded down)."""
        self.trees, self.max_depth, self.min_leaf, self.bootstrap, self.features, self.seed, self.bins = trees, max_depth, min_leaf, bootstrap, features, seed, bins
        self.nodes: list[dict[int, forest.Node]] = []
        self.columns: list[str] = []
        self.k = 0

    def _rules(self, columns: Sequence[str], k: int) -> forest.Rules:
        f = len(columns)
        return forest.Rules(k, f, self.max_depth, self.min_leaf, min(f, self.features or max(1, int(f**0.5))), self.bootstrap)

    def _specs(self, folds: int | None = None) -> list[forest.Spec]:
        return [forest.Spec(f * self.trees + t, forest.tree_seed(self.seed, t), f if folds else -1) for f in range(folds or 1) for t in range(self.trees)]

    def fit(self, df: DataFrame, columns: Sequence[str], label: str, k: int, key: str | None = None) -> Forest:
        """Fits on all rows with a label (0 to k - 1). key: a column of distinct numbers from 0 on, by which rows are drawn; without one, rows are numbered as they lie."""
        self.columns, self.k = list(columns), k
        self.cuts = forest.bin_edges(df, columns, self.bins)
        rows = forest.binned(df, columns, label, self.cuts, k, None if key is None else F.col(key))
        self.nodes = forest.grow(rows, self._specs(), self._rules(columns, k))
        return self

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The kept columns, y_pred and probabilities (the classes' shares of the votes)."""
        return forest.vote(df, keep, self.columns, [(-1, forest.fitted(t, self.cuts)) for t in self.nodes], self.k)

    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, forest.importances(self.nodes, len(self.columns)).tolist(), strict=True))


def cross_validate(df: DataFrame, key: str, columns: Sequence[str], label: str, k_classes: int, folds: int = 5, seed: int = 42, **options: float | None) -> DataFrame:
    """y_true, y_pred of every row, each predicted by the forest of the other folds. All folds' trees are grown in the same jobs: a tree draws no row of its fold."""
    model, dealt = Forest(seed=seed, **options), cut(kfold(df, key, folds, seed))
    cuts = forest.bin_edges(dealt, columns, model.bins)
    rows = forest.binned(dealt, columns, label, cuts, k_classes, F.col(key), F.col("fold"))
    specs = model._specs(folds)
    grown = forest.grow(rows, specs, model._rules(columns, k_classes))
    trees = [(s.without, forest.fitted(t, cuts)) for s, t in zip(specs, grown, strict=True)]
    judged = forest.vote(dealt, [label], columns, trees, k_classes, "fold")
    return judged.select(F.col(label).cast("long").alias("y_true"), "y_pred")
