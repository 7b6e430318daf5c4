"""Result lines of running programs, read as they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.runs import parse_results


def stream_results(spark: SparkSession, folder: str, fields: Sequence[str]) -> DataFrame:
    """A stream of the `[RESULT]` lines of files that appear in a folder."""
    return parse_results(spark.readStream.text(folder), fields)
