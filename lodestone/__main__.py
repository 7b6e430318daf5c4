"""`spark-submit lodestone/__main__.py` or `python -m lodestone`: one run over a graph, its times and its result as lines."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession

from lodestone.operators.endtoend import analyse, lines
from lodestone.sources.graphs import Graph

HELP = """Options:
  --vertices N    vertices of a generated graph (10000)
  --trees N       trees of the forest (50)
  --bc-samples N  sources of betweenness (200; 0: all)
  --threads N     cores of a local session; a session of spark-submit keeps its own
  --sequential    the same as --threads 1
  --input FILE    an edge list to read instead
  --help          these lines"""


class Options(NamedTuple):
    vertices: int = 10_000
    trees: int = 50
    bc_samples: int = 200
    threads: int = 0
    input: str = ""
    help: bool = False


def options(args: Sequence[str]) -> Options:
    """Of a repeated flag the last one holds; unknown flags, and flags that lack their value, are passed over. A value that is no number raises."""
    o, left = Options(), list(args)
    while left:
        flag = left.pop(0)
        if flag == "--help":
            o = o._replace(help=True)
        elif flag == "--sequential":
            o = o._replace(threads=1)
        elif flag == "--input" and left:
            o = o._replace(input=left.pop(0))
        elif flag in ("--vertices", "--trees", "--bc-samples", "--threads") and left:
            o = o._replace(**{flag[2:].replace("-", "_"): int(left.pop(0))})
    return o


def main(args: Sequence[str]) -> None:
    o = options(args)
    if o.help:
        print(HELP)
        return
    builder = SparkSession.builder.appName("lodestone")
    if o.threads > 0 and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{o.threads}]")
    spark = builder.getOrCreate()
    build = (lambda: Graph.from_file(spark, o.input)) if o.input else (lambda: Graph.barabasi_albert(spark, o.vertices, 3))
    for line in lines(analyse(build, o.trees, o.bc_samples)):
        print(line)


if __name__ == "__main__":
    main(sys.argv[1:])
