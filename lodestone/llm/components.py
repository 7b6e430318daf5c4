"""Connected components by alternating large and small stars; every step is a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut_and_observe
from lodestone.llm.common import cut

#: Up to this many edges (16 MB), each node's least neighbour is broadcast, so that the centre of a large star isn't one task's work; of more, the join is by shuffle, from a written side, so that AQE can split hot centres.
BROADCAST_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Joins the neighbours of every node to the least of them: the larger neighbours (large) or the smaller ones and the node itself (small)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "node")
    joined = both.join(F.broadcast(least) if few else cut(least), F.col("a") == F.col("node"))
    if large:
        made = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return made.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b), both long. Edges between a node and itself, and repeated ones, do no harm."""
    measures = {"n": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    start = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    now, state = cut_and_observe(start, **measures)
    while True:
        few = state["n"] <= BROADCAST_EDGES
        now, found = cut_and_observe(_star(_star(now, True, few), False, few), **measures)
        if found == state:
            break
        state = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
