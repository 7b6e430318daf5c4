"""Trees on all rows: equal to a plain tree whichever way they are grown, with draws, folds, ties, gaps and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.portable import portable_hash, portable_hash_numpy
from lodestone.operators import forest as T
from lodestone.operators import graph as G
from lodestone.operators import learning as L
from lodestone.operators.numeric import zscore
from lodestone.sources.graphs import Graph

COLUMNS = ["a", "b", "c", "d"]


def sample(n=2000, seed=5):
    r = np.random.default_rng(seed)
    x = np.round(r.random((n, 4)) * 30)
    return x, ((x[:, 0] > 15).astype(int) + (x[:, 1] * x[:, 2] > 200) + (r.random(n) < 0.1)).astype(int)


@pytest.fixture(scope="module")
def table(spark):
    x, y = sample()
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, label int")
    return df.repartition(5).persist()


def paths(monkeypatch):
    """All in one task a tree; level by level to the end; level by level, a few nodes a job; and a mixture."""
    for finish, cells in ((20_000_000, 1 << 22), (0, 1 << 22), (0, 3 * 4 * T.BINS * 4), (1500, 1 << 22)):
        monkeypatch.setattr(T, "FINISH_ROWS", finish)
        monkeypatch.setattr(T, "CELLS", cells)
        yield


def test_tree_equals_the_plain_one(table, monkeypatch):
    x, y = sample()
    plain = L.Cart(max_depth=6, features=4).fit(x, y, 4)
    for _ in paths(monkeypatch):
        model = L.Forest(trees=1, max_depth=6, bootstrap=None, features=4).fit(table, COLUMNS, "label", 4, "id")
        got = {r.id: (r.y_pred, r.probabilities) for r in model.predict(table, ["id"]).collect()}
        assert [got[i][0] for i in range(len(y))] == plain.predict(x).tolist()
        assert all(p[v] == 1.0 and sum(p) == 1.0 for v, p in got.values())
        assert sum(map(len, model.nodes)) == len(plain.nodes)
        assert list(model.importances().values()) == pytest.approx((plain.importance / plain.importance.sum()).tolist())


def test_forest_is_the_same_whichever_way_it_grows(table, monkeypatch):
    grown = [L.Forest(trees=5, max_depth=6, features=2).fit(table, COLUMNS, "label", 4, "id").nodes for _ in paths(monkeypatch)]
    assert all(g == grown[0] for g in grown[1:])
    again = L.Forest(trees=5, max_depth=6, features=2).fit(table.repartition(3, "b"), COLUMNS, "label", 4, "id").nodes
    assert again == grown[0]  # rows are drawn by their keys, however they lie
    assert len({tuple(sorted(t.items())) for t in grown[0]}) == 5


def test_drawn_trees_equal_plain_ones_of_the_drawn_rows(table):
    x, y = sample()
    model = L.Forest(trees=3, max_depth=5, bootstrap=0.8, features=4, seed=9).fit(table, COLUMNS, "label", 4, "id")
    for t, nodes in enumerate(model.nodes):
        w = T.draws(np.arange(len(y)), T.tree_seed(9, t), 0.8)
        assert 0.7 < w.mean() < 0.9 and w.max() >= 3 and nodes[1].n == w.sum()
        rows = np.repeat(np.arange(len(y)), w)
        plain = L.Cart(max_depth=5, features=4).fit(x[rows], y[rows], 4)
        assert (T.fitted(nodes, model.cuts).predict(x) == plain.predict(x)).all()


def test_hash_of_arrays(spark):
    keys = [0, 1, 2, 1000, 123456789, 2**32]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(portable_hash(F.col("k"), 77)).collect()]
    assert portable_hash_numpy(np.array(keys), 77).tolist() == want


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(20_000).select((F.col("id") / 7).alias("x"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") > 12_345).cast("int").alias("label"))
    x, y = T.bin_edges(df, ["x", "y"])
    assert y.values.tolist() == [0.0, 1.0, 2.0] and y.threshold(0, 2) == 1.0 and x.values is None and 200 < len(x.edges) <= 255 and (np.diff(x.edges) > 0).all()
    model = L.Forest(trees=1, max_depth=4, bootstrap=None, features=2).fit(df, ["x", "y"], "label", 2)
    wrong = model.predict(df, ["label"]).filter("label <> y_pred").count()
    assert wrong <= 20_000 / 256 * 1.5


def test_odd_values_and_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 1.0, 1), (None, 1.0, 1), (5.0, 1.0, 0), (-inf, None, 0), (inf, 2.0, 1), (-0.0, 2.0, 0), (0.0, 2.0, 0), (3.0, 2.0, None)] * 4
    df = spark.createDataFrame(rows, "x double, y double, label int")
    model = L.Forest(trees=1, max_depth=4, min_leaf=1, bootstrap=None, features=2).fit(df, ["x", "y"], "label", 2)
    assert model.nodes[0][1].n == 28  # rows without a label teach nothing
    got = model.predict(df, ["x", "label"]).collect()
    assert len(got) == 32 and all(r.y_pred == r.label for r in got if r.label is not None)
    flat = L.Forest(trees=2, features=2).fit(df.filter("label = 1"), ["x", "y"], "label", 2)
    assert all(t[1].feature == -1 and t[1].label == 1 for t in flat.nodes) and set(flat.importances().values()) == {0.0}
    none = L.Forest(trees=2).fit(df.filter("false"), ["x", "y"], "label", 2)
    assert [t[1] for t in none.nodes] == [T.Node(*T.NO_SPLIT, 0, 0)] * 2 and {r.y_pred for r in none.predict(df, ["x"]).collect()} == {0}
    with pytest.raises(Exception, match="labels must be"):
        L.Forest(trees=1).fit(df, ["x", "y"], "label", 1)
    gaps = df.withColumn("key", F.when(F.col("y") > 1, F.col("y")).cast("long"))
    assert L.Forest(trees=1, min_leaf=1).fit(gaps, ["x", "y"], "label", 2, "key").nodes[0][1].n > 0
    with pytest.raises(ValueError):
        T.grow(df, [T.Spec(0, 1)], T.Rules(2, 2, 61, 5, 1, None), 1)


def test_folds_are_grown_together_and_apart_alike(table):
    """Each row is judged by a tree that didn't see its fold: the same as fitting fold by fold."""
    x, y = sample()
    judged = L.cross_validate(table, "id", COLUMNS, "label", 4, folds=3, trees=1, max_depth=5, bootstrap=None, features=4)
    fold = {r.id: r.fold for r in G.kfold(table, "id", 3, 42).collect()}
    folds = np.array([fold[i] for i in range(len(y))])
    want = np.zeros(len(y), dtype=int)
    for f in range(3):
        want[folds == f] = L.Cart(max_depth=5, features=4).fit(x[folds != f], y[folds != f], 4).predict(x[folds == f])
    pairs = sorted((r.y_true, r.y_pred) for r in judged.collect())
    assert pairs == sorted(zip(y.tolist(), want.tolist(), strict=True)) and sum(a == b for a, b in pairs) > 0.75 * len(y)


def test_cross_validation_by_hand(spark):
    """x tells the label apart from two rows; whichever fold is left out, its rows are judged by x <= 0.5 alone."""
    rows = [(i, float(i % 2), float(i % 5), int(i % 2 == 1) if i not in (3, 8) else int(i % 2 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, label int")
    pairs = L.cross_validate(df, "id", ["x", "noise"], "label", 2, trees=1, max_depth=1, bootstrap=None, features=2).groupBy("y_true", "y_pred").count().collect()
    assert {(r.y_true, r.y_pred): r["count"] for r in pairs} == {(0, 0): 29, (1, 1): 29, (0, 1): 1, (1, 0): 1}


def test_forest_tells_degree_classes_of_a_grown_graph(spark):
    """Degree classes of a preferential-attachment graph from three other features, on a fifth of the vertices held out."""
    g = G.settled(Graph.barabasi_albert(spark, 2000, 3))
    features = ["pagerank", "clustering", "betweenness"]
    scaled = zscore(G.extract_features(g, [lambda h: G.pagerank(h, tolerance=0.0, max_iter=8), G.clustering_coefficient, lambda h: G.betweenness(h, 100)]), features)
    labelled = scaled.join(G.label_bins(G.log_degree(g), "score"), "v")
    data = G.train_test_split(labelled, "v")
    model = L.Forest(trees=30).fit(data.filter("NOT is_test"), features, "label", 5, "v")
    held_out = model.predict(data.filter("is_test"), ["label"]).select(F.col("label").alias("y_true"), "y_pred")
    assert L.macro(held_out, 5).first().macro_f1 > 0.6
