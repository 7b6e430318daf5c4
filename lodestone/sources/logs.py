"""Benchmark logs and datasets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "mode STRING, vertices LONG, threads LONG, run LONG, edges LONG, load_ms DOUBLE, features_ms DOUBLE, normalise_ms DOUBLE, train_ms DOUBLE, evaluate_ms DOUBLE, total_ms DOUBLE, accuracy DOUBLE, f1 DOUBLE"


def read_runs(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """A CSV with a header; cells that don't fit their column's type are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.option("header", True).mode("overwrite").csv(path)


def list_datasets(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """name, path, bytes of the files in a folder, whatever store it is in; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name"), "path", F.col("length").alias("bytes"))
