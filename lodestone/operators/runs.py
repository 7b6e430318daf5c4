"""Analytics of benchmark runs: rows with threads, vertices, total_ms and the like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = r"\[RESULT\]\s*(.*)"


def parse_results(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """value -> the fields (double) of `[RESULT] k=v,k=v` lines; other lines are dropped, missing fields are null."""
    pairs = F.str_to_map(F.trim(F.regexp_extract("value", RESULT, 1)), F.lit(","), F.lit("="))
    return lines.filter(F.col("value").contains("[RESULT]")).select(pairs.alias("kv")).select(*(F.try_element_at("kv", F.lit(k)).try_cast("double").alias(k) for k in fields))


def parse_timings(lines: DataFrame) -> DataFrame:
    """value -> phase, ms of `[Timing] phase: x ms` lines."""
    form = r"\[Timing\]\s*([^:]+):\s*([0-9.]+)\s*ms"
    return lines.filter(F.col("value").rlike(form)).select(F.trim(F.regexp_extract("value", form, 1)).alias("phase"), F.regexp_extract("value", form, 2).cast("double").alias("ms"))


def parse_accuracy(lines: DataFrame) -> DataFrame:
    """value -> accuracy (a share) of `Accuracy: x %` lines."""
    form = r"Accuracy:\s*([0-9.]+)\s*%"
    return lines.filter(F.col("value").rlike(form)).select((F.regexp_extract("value", form, 1).try_cast("double") / 100).alias("accuracy"))


def parse_device(lines: DataFrame) -> DataFrame:
    """value -> device, vertices of lines like `CPU 120` or `GPU: 80`, which say how many vertices a device has taken."""
    form = r"^\s*(CPU|GPU):?\s+(\d+)"
    return lines.filter(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).alias("device"), F.regexp_extract("value", form, 2).cast("long").alias("vertices"))


def format_result(columns: Sequence[str]) -> Column:
    return F.concat(F.lit("[RESULT] "), F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns)))


def summary(runs: DataFrame) -> DataFrame:
    """Per threads and vertices: avg_ms, best_ms, edges (the last run's), edges per ms (0 without time), and the mean accuracy and f1 of runs that have them."""
    quality = [F.avg(c).alias(f"avg_{c}") for c in ("accuracy", "f1") if c in runs.columns]
    per = runs.groupBy("threads", "vertices").agg(F.avg("total_ms").alias("avg_ms"), F.min("total_ms").alias("best_ms"), F.max_by("edges", "run").alias("edges"), *quality)
    return per.withColumn("throughput", F.when(F.col("avg_ms") > 0, F.col("edges") / F.col("avg_ms")).otherwise(0.0))


def efficiency(runs: DataFrame) -> DataFrame:
    """The summary with speedup over one thread and speedup per thread; 0 without a run on one thread."""
    s = summary(runs)
    base = s.filter("threads = 1").select("vertices", F.col("avg_ms").alias("base_ms"))
    joined = s.join(base, "vertices", "left")
    speedup = F.when(F.col("base_ms").isNotNull() & (F.col("avg_ms") > 0), F.col("base_ms") / F.col("avg_ms")).otherwise(0.0)
    return joined.select("threads", "vertices", "avg_ms", speedup.alias("speedup"), (speedup / F.col("threads")).alias("efficiency"))


def speedup_curve(runs: DataFrame) -> DataFrame:
    """Per size, speedup over the fewest threads that were run."""
    w = Window.partitionBy("vertices").orderBy("threads")
    return summary(runs).select("vertices", "threads", (F.first("avg_ms").over(w) / F.col("avg_ms")).alias("speedup"))


def most_threads(runs: DataFrame) -> DataFrame:
    """Per size, the row with most threads (of ties the best time)."""
    return summary(runs).groupBy("vertices").agg(F.max_by(F.struct("threads", "avg_ms", "best_ms"), F.struct("threads", -F.col("best_ms"))).alias("s")).select("vertices", "s.threads", "s.avg_ms", "s.best_ms")


def pivot_modes(runs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Per dataset, the last run's time in each mode; 0 without one."""
    wide = runs.groupBy("dataset").pivot("mode", list(modes)).agg(F.max_by("total_ms", "run"))
    return wide.fillna(0.0, list(modes))


def phase_stack(phases: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """key, phase, ms, bottom: the phases one on another in the order given; a run's row holds all of them, so nothing is shuffled."""
    bottom = [sum((F.col(x) for x in names[:k]), F.lit(0.0)) for k in range(len(names))]
    return phases.select(key, F.inline(F.array(*(F.struct(F.lit(x).alias("phase"), F.col(x).cast("double").alias("ms"), b.alias("bottom")) for x, b in zip(names, bottom, strict=True)))))
