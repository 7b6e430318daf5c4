"""A whole run: graph, features, scaling, labels, a forest and its evaluation, phase by phase with their times."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.operators import graph as G
from lodestone.operators import learning as L
from lodestone.operators.numeric import zscore
from lodestone.sources.graphs import Graph

FEATURES = ["degree_centrality", "betweenness", "pagerank", "clustering"]
#: Phases of a run, by the names that its lines carry and those of the result.
PHASES = {"Graph generation": "ingest_ms", "Feature extraction": "features_ms", "Preprocessing": "preproc_ms", "RF training": "train_ms", "Inference": "infer_ms"}


class Run(NamedTuple):
    """threads, vertices, edges (arcs), times of PHASES in ms, judged (y_true, y_pred of the test rows), the forest and its classes."""

    threads: int
    vertices: int
    edges: int
    times: dict[str, float]
    judged: DataFrame
    forest: L.Forest
    classes: int

    def metrics(self) -> DataFrame:
        return L.macro(self.judged, self.classes)


def analyse(build: Callable[[], Graph], trees: int = 50, samples: int = 200, classes: int = 5, rounds: int = 100, tolerance: float = 1e-6, test_share: float = 0.2) -> Run:
    """Vertices of the graph are told apart by degree class from four z-scored features; a test_share of them is held out. Every phase is written before the next begins, so that its time is its own."""
    times: dict[str, float] = {}

    def timed(name: str, f: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        out = f()
        times[PHASES[name]] = 1000 * (time.perf_counter() - began)
        return out

    g = timed("Graph generation", lambda: G.settled(build()))
    stats = G.graph_stats(g).first()
    extractors = [G.degree_centrality, lambda x: G.betweenness(x, samples), lambda x: G.pagerank(x, tolerance=tolerance, max_iter=rounds), G.clustering_coefficient]
    features = timed("Feature extraction", lambda: cut(G.extract_features(g, extractors)))

    def prepared() -> DataFrame:
        labels = G.label_bins(G.log_degree(g), "score", classes)
        return cut(G.train_test_split(zscore(features, FEATURES).join(labels, "v"), "v", test_share))

    data = timed("Preprocessing", prepared)
    model = timed("RF training", lambda: L.Forest(trees, max_depth=10).fit(data.filter("NOT is_test"), FEATURES, "label", classes, "v"))
    judged = timed("Inference", lambda: cut(model.predict(data.filter("is_test"), ["label"]).select(F.col("label").alias("y_true"), "y_pred")))
    threads = g.vertices.sparkSession.sparkContext.defaultParallelism
    return Run(threads, stats.n_vertices, stats.n_arcs, times, judged, model, classes)


def lines(run: Run) -> list[str]:
    """What a run prints: its phases, the report by class, accuracy, and the line that sweeps gather."""
    m = run.metrics().first()
    total = sum(run.times.values())
    out = [f"[Timing] {name}: {run.times[key]:.2f} ms" for name, key in PHASES.items()]
    out += [r.line for r in L.format_report(L.per_class(run.judged, run.classes)).orderBy("class").collect()]
    out += [f"Accuracy: {100 * m.accuracy:.2f} %"]
    fields = {"threads": run.threads, "vertices": run.vertices, "edges": run.edges} | {k: f"{v:.2f}" for k, v in run.times.items()} | {"total_ms": f"{total:.2f}", "accuracy": f"{m.accuracy:.2f}", "f1": f"{m.macro_f1:.2f}"}
    return [*out, "[RESULT] " + ",".join(f"{k}={v}" for k, v in fields.items())]
