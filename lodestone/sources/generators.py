"""Matrices, vectors, particles and sequences made by rule, each row where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.portable import portable_hash


def uniform(i: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 (exclusive) for each whole number i."""
    return portable_hash(i, seed) / F.lit(2147483648.0)


def uniform_matrix(spark: SparkSession, rows: int, columns: int, seed: int = 42) -> DataFrame:
    """i, j, x: x uniform between 0 and 1."""
    cells = spark.range(rows * columns)
    return cells.select(F.floor(F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"), uniform(F.col("id"), seed).alias("x"))


def closed_form_vectors(spark: SparkSession, n: int) -> DataFrame:
    """i, x = i / 2, y = 2 i: vectors whose sums and products have closed forms."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 0.5).alias("x"), (F.col("id") * 2.0).alias("y"))


def particles(spark: SparkSession, n: int, box: float = 10.0, seed: int = 42) -> DataFrame:
    """id, x, y, z: n particles in a cube of side box."""
    return spark.range(n).select("id", *((uniform(F.col("id") * 3 + k, seed) * box).alias(c) for k, c in enumerate("xyz")))


def sequences(spark: SparkSession, n: int, length: int, letters: str = "ACGT", seed: int = 42) -> DataFrame:
    """id, s: n sequences of so many letters."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))
    letter = lambda k: F.substring(F.lit(letters), (F.floor(uniform(F.col("id") * length + k, seed) * len(letters)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select("id", F.array_join(F.transform(places, letter), "").alias("s"))


def two_classes(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, x, y, label: points of two classes a unit apart along either axis."""
    label = (F.col("id") % 2).cast("int")
    return spark.range(n).select("id", *((uniform(F.col("id") * 2 + k, seed) + label).alias(c) for k, c in enumerate("xy")), label.alias("label"))
