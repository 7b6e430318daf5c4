"""All unordered pairs of a table's rows, as an equi-join of blocks instead of a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task lays two of them side by side.
BLOCK_ROWS = 2000


def block_count(df: DataFrame) -> int:
    """Blocks for the rows of df: of BLOCK_ROWS at most, and so many that their meetings keep all cores busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(df.count() / BLOCK_ROWS), math.ceil(math.sqrt(16 * cores)))


def block_pairs(df: DataFrame, key: str, blocks: int | None = None, include_self: bool = False) -> DataFrame:
    """Columns a and b (structs of df's rows) for a.key < b.key (or <=). Each row goes to `blocks` meetings (by default `block_count`), of which there are blocks * (blocks + 1) / 2 with 2 / blocks of the rows each."""
    blocks = blocks or block_count(df)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")
    others = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    row = F.struct(*df.columns)
    meet = (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("meet")
    # by a number of its own, as few bytes of rows make many pairs, which must not all go to a few tasks
    spread = df.select(row.alias("row"), block.alias("own"), F.explode(others).alias("other")).withColumn("to", meet).repartition(min(1000, blocks * (blocks + 1) // 2), "to")
    meet = F.col("to").alias("meet")
    a = spread.select(meet, F.col("own").alias("own_a"), F.col("row").alias("a"))
    b = spread.select(meet, F.col("own").alias("own_b"), F.col("row").alias("b"))
    order = F.col(f"a.{key}") <= F.col(f"b.{key}") if include_self else F.col(f"a.{key}") < F.col(f"b.{key}")
    once = F.least("own_a", "own_b") * blocks + F.greatest("own_a", "own_b") == F.col("meet")
    return a.join(b, "meet").filter(order & once).select("a", "b")
