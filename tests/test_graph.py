import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import centrality
from lodestone.operators import graph as G
from lodestone.operators.pairs import block_pairs
from lodestone.sources.graphs import Graph, copurchase_edges, copurchase_graph, parse_edge_lines


def graph(spark, edges, directed=False, n=None):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), directed, n)


def column(df, name):
    return [r[name] for r in df.orderBy("v").collect()]


def star(spark, leaves):
    return graph(spark, [(0, i) for i in range(1, leaves + 1)])


def test_triangle(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)])
    assert g.arcs.count() == 6
    assert column(G.degrees(g), "deg") == [2, 2, 2]
    assert column(G.clustering_coefficient(g), "clustering") == [1.0, 1.0, 1.0]
    assert column(G.betweenness(g), "betweenness") == [0.0, 0.0, 0.0]


def test_directed_path(spark):
    g = graph(spark, [(0, 1), (1, 2)], directed=True)
    assert column(G.degrees(g), "deg") == [1, 1, 0]
    assert column(G.betweenness(g), "betweenness") == [0.0, 0.5, 0.0]
    assert column(G.pagerank(g), "pagerank") == pytest.approx([0.184417, 0.341171, 0.474412], abs=1e-5)
    assert column(G.degree_centrality(g), "in_degree") == [0.0, 0.5, 0.5]


def test_duplicates_and_gaps(spark):
    assert graph(spark, [(0, 1)] * 3, directed=True).arcs.count() == 1
    g = graph(spark, [(0, 4)])
    assert g.vertices.count() == 5
    assert column(G.degrees(g), "deg") == [1, 0, 0, 0, 1]


def test_star(spark):
    g = star(spark, 4)
    assert column(G.degree_centrality(g), "degree_centrality") == [1.0, 0.25, 0.25, 0.25, 0.25]
    assert column(G.betweenness(g), "betweenness") == [2.0, 0.0, 0.0, 0.0, 0.0]
    assert column(G.betweenness(g, convention="standard"), "betweenness")[0] == 1.0
    assert column(G.pagerank(g), "pagerank") == pytest.approx([0.475676] + [0.131081] * 4, abs=1e-5)


def test_loops_count_as_neighbours_only(spark):
    g = graph(spark, [(0, 0), (0, 1), (1, 2), (0, 2)])
    assert column(G.degrees(g), "deg") == [3, 2, 2]
    assert column(G.clustering_coefficient(g), "clustering") == pytest.approx([1 / 3, 1.0, 1.0])


def test_empty_and_negative(spark):
    g = graph(spark, [])
    assert G.degrees(g).count() == 0 and G.pagerank(g).count() == 0 and G.graph_stats(g).first().n_vertices == 0
    assert G.adaptive_threshold(g).count() == 0 and G.betweenness(g).count() == 0
    with pytest.raises(ValueError):
        graph(spark, [(-1, 2)])
    with pytest.raises(ValueError):
        Graph.barabasi_albert(spark, 3, 3)
    with pytest.raises(ValueError):
        G.extract_features(g, [])
    with pytest.raises(NotImplementedError):
        Graph.from_file(spark, "x", "metis")


def test_edge_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# comment\n\n0 1\n1 2 2.5\n2 0 x\n3,4\n1.5 2\nhello\n")
    g = Graph.from_file(spark, str(tmp_path / "g.txt"))
    assert (g.vertices.count(), g.arcs.count()) == (3, 6)
    lines = spark.read.text(str(tmp_path / "g.txt"))
    assert sorted(map(tuple, parse_edge_lines(lines, weighted=True).collect())) == [(0, 1, 1.0), (1, 2, 2.5), (2, 0, 0.0)]


def test_generators(spark):
    g = Graph.barabasi_albert(spark, 100, 3)
    assert (g.vertices.count(), g.arcs.count()) == (100, 588)
    e = Graph.erdos_renyi(spark, 20, 0.3)
    assert math.isclose(sum(column(G.pagerank(e), "pagerank")), 1.0, abs_tol=1e-3)
    assert e.arcs.count() == 2 * e.arcs.filter("src < dst").count()


def test_block_pairs_give_each_pair_once(spark):
    got = block_pairs(spark.range(30), "id", 4).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted((r.id, r.other) for r in got) == [(i, j) for i in range(30) for j in range(i + 1, 30)]


def test_label_bins_and_offsets(spark):
    g = graph(spark, [(0, 1)], n=7)
    assert sorted(r.label for r in G.label_bins(G.degrees(g), "deg").collect()) == [0, 0, 1, 2, 2, 3, 4]
    offsets = G.row_offsets(star(spark, 3)).orderBy("v").collect()
    assert [(r.row_start, r.row_end) for r in offsets] == [(0, 3), (3, 4), (4, 5), (5, 6)]


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(50)
    a = {(r.id, r.is_test) for r in G.train_test_split(df, "id", 0.2, 7).collect()}
    assert sum(t for _, t in a) == 10 and a == {(r.id, r.is_test) for r in G.train_test_split(df, "id", 0.2, 7).collect()}
    folds = [r.fold for r in G.kfold(df, "id", 5).collect()]
    assert sorted(folds) == sorted(list(range(5)) * 10)


def test_workload_limit_moves_the_largest_ids(spark):
    side = {r.v: r.side for r in G.workload_split(star(spark, 5), 4, 3).collect()}
    assert side == {0: "cpu", 1: "gpu", 2: "gpu", 3: "gpu", 4: "cpu", 5: "cpu"}


def test_workload_has_no_limit_unless_one_is_given(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), n=1_000_002, checked=True)
    assert {r.side: r["count"] for r in G.workload_split(g).groupBy("side").count().collect()} == {"gpu": 1_000_002}


def test_copurchases_gather_an_order_once(spark):
    lines = spark.createDataFrame([(1, 5, 50.0), (1, 5, 50.0), (1, 3, 50.0), (1, 9, 1.0), (2, 3, 50.0), (2, 5, 50.0), (None, 1, 50.0), (None, 2, 50.0), (3, None, 50.0), (3, 7, 50.0)], "l_orderkey long, l_partkey long, l_quantity double")
    edges = copurchase_edges(lines)
    assert [tuple(r) for r in edges.collect()] == [(3, 5)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(") <= 2  # of orders, of edges


def test_directed_clustering_equals_brute_force(spark):
    r = random.Random(5)
    arcs = {(r.randrange(25), r.randrange(25)) for _ in range(160)} | {(0, k) for k in range(1, 25)}
    g = Graph.from_edges(spark.createDataFrame(sorted(arcs), "src long, dst long"), directed=True)
    got = {x.v: x.clustering for x in G.clustering_coefficient(g).collect()}
    for v in range(25):
        deg = sum(a == v for a, _ in arcs)
        ends = [b for a, b in arcs if a == v and b != v]
        found = sum((x, y) in arcs for x in ends for y in ends if x != y) // 2
        assert got[v] == pytest.approx(found / (deg * (deg - 1) / 2) if deg > 1 else 0.0)


def test_hub_positions(spark):
    arcs = [(0, k) for k in range(1, 300)] + [(k, 0) for k in range(1, 300)] + [(7, 9)]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long"), directed=True)
    got = {(x.src, x.dst): x.position for x in G.arc_positions(g).collect()}
    assert got[0, 1] == 0 and got[0, 299] == 298 and got[7, 0] == 0 and got[7, 9] == 1 and len(got) == len(arcs)


def test_pagerank_stops_at_its_tolerance(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long"), n=6)
    rank = {v: 1 / 6 for v in range(6)}
    near = {0: [1], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3], 5: []}
    for rounds in range(1, 101):
        lost = sum(rank[v] for v in near if not near[v])
        new = {v: 0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
        change, rank = sum(abs(new[v] - rank[v]) for v in near), new
        if change < 1e-4:
            break
    got = {x.v: x.pagerank for x in G.pagerank(g, tolerance=1e-4).collect()}
    assert rounds < 100 and all(got[v] == pytest.approx(rank[v], abs=1e-12) for v in near)


def test_hub_arcs_lie_in_all_tasks(spark, monkeypatch):
    """A star of 400,000 rays beside 4,000 rings: no part of the hub's arcs above twice the median, and the ranks are those of the undivided graph."""
    rays, rings = 400_000, 4_000
    star = spark.range(1, rays + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    ring = spark.range(rings).select((F.col("id") + 1).alias("src"), ((F.col("id") + 1) % rings + 1).alias("dst"))
    g = G.settled(Graph.from_edges(star.unionByName(ring), n=rays + 2, checked=True))
    monkeypatch.setattr(G, "HUB_ARCS", 1000)
    light, heavy, hubs = G.dealt_arcs(g, G.degrees(g), 2 * (rays + rings), rays, 16)
    assert [r.v for r in hubs.collect()] == [0]
    for part, arcs in ((heavy, rays), (light, rays + 2 * rings)):
        sizes = sorted(r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sum(sizes) == arcs and sizes[-1] <= 2 * sizes[8]
    cut_up = G.pagerank(g, tolerance=0.0, max_iter=3)
    monkeypatch.setattr(G, "HUB_ARCS", 10**9)
    whole = G.pagerank(g, tolerance=0.0, max_iter=3)
    assert cut_up.join(whole.withColumnRenamed("pagerank", "other"), "v").filter(F.abs(F.col("pagerank") - F.col("other")) > 1e-9 * F.col("other")).isEmpty()
    assert abs(cut_up.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9


def brandes(n, arcs):
    """Plain queues, vertex by vertex."""
    out, total = [[] for _ in range(n)], [0.0] * n
    for a, b in arcs:
        out[a].append(b)
    for s in range(n):
        level, sigma, order, before = {s: 0}, dict.fromkeys(range(n), 0.0), [s], {}
        sigma[s] = 1.0
        for v in order:
            for w in out[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
                    before.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return total


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("dealt", [False, True])
def test_betweenness_equals_brute_force(spark, monkeypatch, directed, dealt):
    """With the graph broadcast, and dealt out with blocks of sources after one another; loops, a separate part and vertices without arcs included."""
    r = random.Random(4)
    edges = sorted({(r.randrange(24), r.randrange(24)) for _ in range(40)} | {(3, 3), (30, 31), (31, 32), (32, 30)})
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), directed=directed, n=35)
    if dealt:
        monkeypatch.setattr(centrality, "BROADCAST_ARCS", 0)
        monkeypatch.setattr(centrality, "BLOCK", 16)
    arcs = [e for e in edges if e[0] != e[1]]
    want = brandes(35, arcs if directed else sorted({*arcs, *((b, a) for a, b in arcs)}))
    got = {x.v: x.betweenness for x in G.betweenness(g, normalise=False).collect()}
    assert len(got) == 35 and all(abs(got[v] - want[v]) < 1e-9 for v in range(35))
    few = {x.v: x.betweenness for x in G.betweenness(g, num_samples=7, normalise=False).collect()}
    assert all(few[v] <= got[v] + 1e-9 for v in range(35))


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("most", [60, 10**6])
def test_connected_parts_are_walked_where_they_are_held(spark, monkeypatch, directed, most):
    """Parts of a graph too large to be broadcast: small ones share bins, others have one each, whose sources several tasks share, and those that no task holds go by blocks."""
    r = random.Random(6)
    edges = {(3, 3), *((b + r.randrange(size), b + r.randrange(size)) for b, size in ((0, 20), (20, 30), (50, 4), (54, 3), (57, 2), (59, 12)) for _ in range(2 * size))}
    g = Graph.from_edges(spark.createDataFrame(sorted(edges), "src long, dst long"), directed=directed, n=75)
    arcs = sorted((a, b) for a, b in (edges if directed else edges | {(b, a) for a, b in edges}) if a != b)
    for name, value in (("BROADCAST_ARCS", most), ("PACKED_ARCS", 20), ("WALKED_ARCS", 50), ("SHARE", 4)):
        monkeypatch.setattr(centrality, name, value)
    want = brandes(75, arcs)
    raw = centrality.by_component(g, g.vertices)
    got = {x.v: x.raw for x in raw.collect()}
    assert len(got) == raw.count() and all(abs(got.get(v, 0.0) - want[v]) < 1e-9 for v in range(75))
    few = {x.v: x.raw for x in centrality.by_component(g, g.vertices.filter("v % 4 = 0")).collect()}
    assert all(few.get(v, 0.0) <= want[v] + 1e-9 for v in range(75)) and sum(few.values()) < sum(want)


@pytest.mark.parametrize("directed", [False, True])
def test_a_walk_leaves_nothing_behind(directed):
    """Levels of few arcs and of many, in one graph of a ring, a dense part and a separate one; all walks share their arrays."""
    r = random.Random(7)
    arcs = {(i, (i + 1) % 300) for i in range(300)} | {(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(900)} | {(300, 301), (301, 302), (302, 300)}
    arcs = sorted((a, b) for a, b in (arcs if directed else arcs | {(b, a) for a, b in arcs}) if a != b)
    src, to = (np.array(x) for x in zip(*arcs, strict=True))
    held = centrality.Held(np.searchsorted(src, np.arange(304)), to)
    for v in range(303):
        held.walk(v)
    assert held.unseen.all() and not held.now.any() and not held.sigma.any() and not held.delta.any()
    assert held.total.tolist() == pytest.approx(brandes(303, arcs))


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_levels_are_broadcast_or_merged(spark, monkeypatch, pairs):
    """Levels of few pairs go to the arcs, larger ones are merged with arcs that lie in order; both give the same."""
    r = random.Random(5)
    edges = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(50)})
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n=30)
    monkeypatch.setattr(centrality, "BROADCAST_ARCS", 0)
    monkeypatch.setattr(centrality, "BROADCAST_PAIRS", pairs)
    want = brandes(30, sorted({*edges, *((b, a) for a, b in edges)}))
    got = {x.v: x.betweenness for x in G.betweenness(g, normalise=False).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in range(30))


def test_arcs_are_written_once_and_not_sorted_again(spark):
    """A settled graph is not written again, its arcs are a table; arcs that are kept in order take no sort to be joined."""
    g = G.settled(star(spark, 50))
    assert G.settled(g) is g and "parquet" in g.arcs._jdf.queryExecution().executedPlan().toString()
    light, _, _ = G.dealt_arcs(g, G.degrees(g), 100, 50, 4)
    light.persist()
    try:
        assert light.count() == 100
        state = G.cut(G.sorted_by(G.degrees(g), 4, "v"))
        plan = light.join(state.hint("merge"), F.col("src") == F.col("v"))._jdf.queryExecution().executedPlan()
        assert "SortMergeJoin" in plan.toString()
        above = plan.toString().split("InMemoryTableScan")[0]
        assert "Sort [" not in above and "Exchange" not in above
    finally:
        light.unpersist()


def test_splits_sort_no_rows(spark, monkeypatch):
    """Folds and splits are those of the ranks, at any size, but rows are neither sorted nor shuffled; equal and null keys are ranked."""
    for n in (0, 1, 3, 7, 1000):
        df = spark.range(n).select((F.col("id") * 37 + 5).alias("k"))
        ranks = {r.k: r["rank"] for r in G.hash_rank(df, "k", 42).collect()}
        folds, split = G.kfold(df, "k"), G.train_test_split(df, "k")
        assert {r.k: r.fold for r in folds.collect()} == {k: sum(r >= f * n // 5 for f in range(1, 5)) for k, r in ranks.items()}
        assert {r.k: r.is_test for r in split.collect()} == {k: r >= n - int(n * 0.2) for k, r in ranks.items()}
        for out in (folds, split):
            assert "Exchange" not in out._jdf.queryExecution().toString()
    for most in (G.PLACE_ROWS, 0):  # with 0, all rows are ranked
        monkeypatch.setattr(G, "PLACE_ROWS", most)
        for keys in ([None] * 6 + [4, 9, 12, 15], [3] * 10, list(range(10))):
            df = spark.createDataFrame([(k,) for k in keys], "k long")
            assert sorted(r.fold for r in G.kfold(df, "k").collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
            assert sum(r.is_test for r in G.train_test_split(df, "k").collect()) == 2


def test_arcs_and_degrees_are_not_shuffled_again(spark, tmp_path, monkeypatch):
    """Arcs of rising edges take no shuffle beyond the edges' own, a settled graph's degrees are read from a table, and PageRank is the same however often its lineage is cut."""
    rows = [(o, p, 45.0) for o in range(40) for p in (o % 7, (3 * o + 1) % 11, (5 * o + 2) % 13)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = copurchase_graph(spark, str(tmp_path))
    want = {(a, b) for o, a, _ in rows for q, b, _ in rows if o == q and a != b}
    assert sorted(map(tuple, g.arcs.select("src", "dst").collect())) == sorted(want)
    plan = g.arcs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Union")[0] and "Exchange" not in plan.split("Union")[0]
    settled = G.settled(g)
    plan = G.degrees(settled)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "Exchange" not in plan and column(G.degrees(settled), "deg") == column(G.degrees(g), "deg")
    ranks = []
    for rounds in (1, 2, 100):
        monkeypatch.setattr(G, "KEPT_ROUNDS", rounds)
        ranks.append(column(G.pagerank(settled, tolerance=0.0, max_iter=5), "pagerank"))
    assert ranks[0] == pytest.approx(ranks[1]) and ranks[0] == pytest.approx(ranks[2])
