"""A whole run and its command line; its lines are read back by the parsers."""

import pytest

from lodestone.__main__ import Options, main, options
from lodestone.operators import graph as G
from lodestone.operators import runs as R
from lodestone.operators.endtoend import FEATURES, PHASES, analyse
from lodestone.plans import graph_queries
from lodestone.sources.graphs import Graph, copurchase_graph
from tests.test_graph import brandes


def test_flags():
    assert options([]) == Options(10_000, 50, 200, 0, "", False)
    assert options("--vertices 5 --trees 2 --vertices 7 --unknown 3 --gpu --bc-samples 0 --input a.txt --sequential".split()) == Options(7, 2, 0, 1, "a.txt")
    assert options("--sequential --threads 4 --trees".split()) == Options(threads=4)
    assert options(["--help"]).help
    with pytest.raises(ValueError):
        options(["--trees", "many"])


def test_help_runs_nothing(capsys):
    main(["--help"])
    assert "--bc-samples" in capsys.readouterr().out


def test_lines_of_a_run_are_read_back(spark, tmp_path, capsys):
    edges = tmp_path / "edges.txt"
    edges.write_text("# a graph\n" + "".join(f"{i} {(i * i + 1) % 60}\n{i} {(i + 1) % 60}\n" for i in range(60)))
    main(["--trees", "4", "--bc-samples", "10", "--input", str(edges), "--trees", "5"])
    printed = capsys.readouterr().out.splitlines()
    log = spark.createDataFrame([(x,) for x in printed], "value string")
    times = {r.phase: r.ms for r in R.parse_timings(log).collect()}
    assert list(times) == list(PHASES) and all(v >= 0 for v in times.values())
    fields = ["threads", "vertices", "edges", *PHASES.values(), "total_ms", "accuracy", "f1"]
    (result,) = R.parse_results(log, fields).collect()
    assert result.vertices == 60 and result.edges == Graph.from_file(spark, str(edges)).arcs.count() and result.threads >= 1
    assert all(abs(result[k] - times[p]) < 0.02 for p, k in PHASES.items()) and abs(result.total_ms - sum(times.values())) < 0.1
    assert 0 <= result.accuracy <= 1 and abs(R.parse_accuracy(log).first().accuracy - result.accuracy) < 0.006


def test_run_tells_degree_classes(spark):
    run = analyse(lambda: Graph.barabasi_albert(spark, 1500, 3), trees=30, samples=100, rounds=10)
    assert run.vertices == 1500 and run.judged.count() == 300 and set(run.forest.importances()) == set(FEATURES)
    assert run.metrics().first().macro_f1 >= 0.7


def test_the_query_does_the_whole_run(spark, tmp_path, monkeypatch):
    """end_to_end: paths from every vertex, PageRank until it settles, as many trees as a run has by itself."""
    rows = [(o, p, 45.0) for o in range(60) for p in (o % 29, (3 * o + 1) % 41, (5 * o * o + 2) % 37)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    runs, made = [], {}
    monkeypatch.setattr(graph_queries, "analyse", lambda *a, **k: runs.append(analyse(*a, **k)) or runs[-1])

    def kept(name):
        f = getattr(G, name)

        def call(g, *args, **options):
            made[name] = {r.v: r[name] for r in f(g, *args, **options).collect()}
            return f(g, *args, **options)

        monkeypatch.setattr(G, name, call)

    kept("betweenness")
    kept("pagerank")
    assert graph_queries.end_to_end(spark, str(tmp_path)).count() == 1
    g = copurchase_graph(spark, str(tmp_path))
    n = g.vertices.count()
    monkeypatch.undo()
    arcs = sorted(map(tuple, g.arcs.select("src", "dst").collect()))
    want = [x / ((n - 1) * (n - 2) / 2) for x in brandes(n, arcs)]
    assert [made["betweenness"][v] for v in range(n)] == pytest.approx(want)
    settled = {r.v: r.pagerank for r in G.pagerank(g).collect()}
    assert [made["pagerank"][v] for v in range(n)] == pytest.approx([settled[v] for v in range(n)], abs=1e-12)
    assert len(runs[0].forest.nodes) == 50
