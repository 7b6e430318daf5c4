"""Graphs as two DataFrames: vertices(v) and arcs(src, dst, weight)."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.portable import portable_hash

EDGE_LINE = r"^\s*([+-]?\d+)\s+([+-]?\d+)(?:\s+(\S+))?"


@dataclass(frozen=True)
class Graph:
    """Ids run from 0 to the largest one used; ids without arcs are vertices too. arcs has one row per (src, dst). settled: arcs are read from a table. degrees: v and deg, where they are at hand."""

    vertices: DataFrame
    arcs: DataFrame
    directed: bool = False
    settled: bool = False
    degrees: DataFrame | None = None

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = False, n: int | None = None, checked: bool = False, rising: bool = False) -> Graph:
        """edges: src, dst and perhaps weight (1.0 if missing). The least weight of repeated edges stays. A negative id raises.

        checked: n is given and no id is negative or beyond it, so that nothing needs to be read now. rising: no edge is repeated and src < dst in all, so that arcs need no shuffle of their own."""
        rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)).alias("weight"))
        low, high = (None, None) if checked else rows.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if low is not None and low < 0:
            raise ValueError("vertex ids must not be negative")
        size = n if n is not None else 0 if high is None else high + 1
        arcs = rows if directed else symmetrize(rows)
        arcs = arcs if rising else dedup_edges(arcs)
        return Graph(edges.sparkSession.range(size).select(F.col("id").alias("v")), arcs, directed)

    @staticmethod
    def from_lines(lines: DataFrame, directed: bool = False, weighted: bool = False) -> Graph:
        return Graph.from_edges(parse_edge_lines(lines, weighted), directed)

    @staticmethod
    def from_file(spark: SparkSession, path: str, form: str = "snap", directed: bool = False, weighted: bool = False) -> Graph:
        if form not in ("snap", "edge_list"):
            raise NotImplementedError(f"no reader for {form} files")
        return Graph.from_lines(spark.read.text(path), directed, weighted)

    @staticmethod
    def barabasi_albert(spark: SparkSession, n: int, m: int = 3, seed: int = 42) -> Graph:
        """Preferential attachment grows vertex by vertex, so the edge list (n * m pairs of integers) is made on the driver."""
        if n < m + 1:
            raise ValueError("n must exceed m")
        r = random.Random(seed)
        edges = [(i, j) for i in range(m + 1) for j in range(i + 1, m + 1)]
        ends = [v for e in edges for v in e]
        for v in range(m + 1, n):
            targets: set[int] = set()
            while len(targets) < m:
                targets.add(r.choice(ends))
            for t in sorted(targets):
                edges.append((v, t))
                ends += (v, t)
        return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n=n)

    @staticmethod
    def erdos_renyi(spark: SparkSession, n: int, p: float = 0.01, seed: int = 42) -> Graph:
        """Each pair i < j is drawn by a hash of its own, where its lower end is: n * n / 2 draws, of which only the edges are shuffled."""
        pairs = spark.range(max(0, n - 1)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
        drawn = pairs.filter(portable_hash(F.col("src") * 1000003 + F.col("dst"), seed) < p * 2147483648)
        return Graph.from_edges(drawn, n=n, checked=True)


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def parse_edge_lines(lines: DataFrame, weighted: bool = False) -> DataFrame:
    """value -> src, dst, weight: comments, empty lines and lines that don't begin with two integers are dropped; a missing weight is 1, one that is no number 0."""
    kept = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike(EDGE_LINE))
    third = F.regexp_extract("value", EDGE_LINE, 3)
    weight = F.when(third == "", 1.0).otherwise(F.coalesce(F.expr(f"try_cast(regexp_extract(value, r'{EDGE_LINE}', 3) AS DOUBLE)"), F.lit(0.0))) if weighted else F.lit(1.0)
    return kept.select(F.regexp_extract("value", EDGE_LINE, 1).cast("long").alias("src"), F.regexp_extract("value", EDGE_LINE, 2).cast("long").alias("dst"), weight.alias("weight"))


def copurchase_edges(lineitem: DataFrame, least_quantity: float = 40.0) -> DataFrame:
    """src < dst: parts that one order holds in such quantities. An order has few lines, so its pairs are few."""
    lines = lineitem.filter(F.col("l_quantity") >= least_quantity)
    parts = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).filter((F.size("parts") > 1) & F.col("l_orderkey").isNotNull())
    left = parts.select("parts", F.explode("parts").alias("src"))
    return left.select("src", F.explode("parts").alias("dst")).filter("src < dst").distinct()


def copurchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lineitem.agg(F.max("l_partkey")).first()[0] + 1
    return Graph.from_edges(copurchase_edges(lineitem), n=n, checked=True, rising=True)
