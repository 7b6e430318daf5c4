"""Queries of the benchmark-run operators; the table events is read as a log of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import checkpoint_dir
from lodestone.functions.portable import rounded
from lodestone.operators import runs as R
from lodestone.plans.tables import Registry, table
from lodestone.sources.logs import read_runs, write_runs

REGISTRY = Registry()
add = REGISTRY.add
_RUNS = """runs AS (SELECT event_id AS run, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END::BIGINT AS threads, event_type AS vertices, value AS total_ms, 100 + user_id AS edges, (user_id % 101) / 100.0::DOUBLE AS accuracy, (user_id % 51) / 50.0::DOUBLE AS f1 FROM events),
s AS (SELECT threads, vertices, avg(total_ms) AS avg_ms, min(total_ms) AS best_ms, arg_max(edges, run) AS edges, avg(accuracy) AS avg_accuracy, avg(f1) AS avg_f1 FROM runs GROUP BY 1, 2)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """threads: a power of two by user; vertices: the type of event, as the size of the graph; total_ms: the value."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("run"), F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 2, 4, 8))), (F.col("user_id") % 4 + 1).cast("int")).alias("threads"), F.col("event_type").alias("vertices"), F.col("value").alias("total_ms"), (100 + F.col("user_id")).alias("edges"), ((F.col("user_id") % 101) / 100.0).alias("accuracy"), ((F.col("user_id") % 51) / 50.0).alias("f1"))


@add(f"WITH {_RUNS} SELECT threads, vertices, round(avg_ms, 6) AS avg_ms, best_ms, edges, round(CASE WHEN avg_ms > 0 THEN edges / avg_ms ELSE 0 END, 6) AS throughput, round(avg_accuracy, 9) AS avg_accuracy, round(avg_f1, 9) AS avg_f1 FROM s")
def perf_summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.summary(_runs(spark, d))
    return s.select("threads", "vertices", rounded(F.col("avg_ms")).alias("avg_ms"), "best_ms", "edges", rounded(F.col("throughput")).alias("throughput"), *(rounded(F.col(c), 9).alias(c) for c in ("avg_accuracy", "avg_f1")))


@add(f"WITH {_RUNS} SELECT run, threads, vertices, total_ms, edges, accuracy, f1 FROM runs")
def runs_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """The runs, written as CSV in the shared folder and read back."""
    runs, path = _runs(spark, d), f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    write_runs(runs, path)
    return read_runs(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema))


@add(f"WITH {_RUNS} SELECT s.threads, s.vertices, round(s.avg_ms, 6) AS avg_ms, round(coalesce(b.avg_ms / s.avg_ms, 0), 6) AS speedup, round(coalesce(b.avg_ms / s.avg_ms, 0) / s.threads, 6) AS efficiency FROM s LEFT JOIN s b ON b.vertices = s.vertices AND b.threads = 1")
def speedup_efficiency(spark: SparkSession, d: str) -> DataFrame:
    s = R.efficiency(_runs(spark, d))
    return s.select("threads", "vertices", *(rounded(F.col(c)).alias(c) for c in ("avg_ms", "speedup", "efficiency")))


@add(f"WITH {_RUNS} SELECT vertices, threads, round(first_value(avg_ms) OVER (PARTITION BY vertices ORDER BY threads) / avg_ms, 6) AS speedup FROM s")
def speedup_curve(spark: SparkSession, d: str) -> DataFrame:
    return R.speedup_curve(_runs(spark, d)).select("vertices", "threads", rounded(F.col("speedup")).alias("speedup"))


@add(f"WITH {_RUNS} SELECT vertices, threads, round(avg_ms, 6) AS avg_ms, best_ms FROM s QUALIFY row_number() OVER (PARTITION BY vertices ORDER BY threads DESC, best_ms) = 1")
def max_thread_per_size(spark: SparkSession, d: str) -> DataFrame:
    return R.most_threads(_runs(spark, d)).select("vertices", "threads", rounded(F.col("avg_ms")).alias("avg_ms"), "best_ms")


@add("SELECT user_id AS dataset, " + ", ".join(f"coalesce(arg_max(value, event_id) FILTER (event_type = '{m}'), 0.0) AS {m}" for m in ("view", "click", "purchase")) + " FROM events GROUP BY user_id")
def pivot_mode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("dataset"), F.col("event_type").alias("mode"), F.col("value").alias("total_ms"), F.col("event_id").alias("run"))
    return R.pivot_modes(e, ["view", "click", "purchase"])


@add("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 9) AS ms, 'quantity' AS phase, 0.0::DOUBLE AS bottom FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_discount, 9), 'discount', round(l_quantity, 9) FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_tax, 9), 'tax', round(l_quantity + l_discount, 9) FROM lineitem""")
def phase_stack(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    line = table(spark, d, "lineitem").select(*keys, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = R.phase_stack(line.withColumn("run", F.struct(*keys, "quantity", "discount", "tax", F.monotonically_increasing_id().alias("n"))), ["quantity", "discount", "tax"], "run")
    return long.select(*(F.col(f"run.{k}").alias(k) for k in keys), rounded(F.col("ms"), 9).alias("ms"), "phase", rounded(F.col("bottom"), 9).alias("bottom"))


@add("SELECT o_orderkey::DOUBLE AS run, o_totalprice AS total_ms, o_custkey::DOUBLE AS edges, NULL::DOUBLE AS f1 FROM orders")
def result_line_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("total_ms"), F.col("o_custkey").alias("edges"))
    lines = o.select(R.format_result(["run", "total_ms", "edges"]).alias("value"))
    return R.parse_results(lines.unionByName(lines.limit(1).select(F.lit("started").alias("value"))), ["run", "total_ms", "edges", "f1"])


@add("SELECT DISTINCT event_type AS vertices FROM events WHERE user_id % 4 = 0 INTERSECT SELECT event_type FROM events WHERE user_id % 4 = 3")
def common_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that were run both on one thread and on eight."""
    r = _runs(spark, d)
    return r.filter("threads = 1").select("vertices").intersect(r.filter("threads = 8").select("vertices"))


@add(f"WITH {_RUNS} SELECT a.vertices, round(a.avg_ms, 6) AS slow_ms, round(b.avg_ms, 6) AS fast_ms FROM s a JOIN s b USING (vertices) WHERE a.threads = 1 AND b.threads = 8")
def mode_join(spark: SparkSession, d: str) -> DataFrame:
    s = R.summary(_runs(spark, d))
    side = lambda n, name: s.filter(F.col("threads") == n).select("vertices", rounded(F.col("avg_ms")).alias(name))
    return side(1, "slow_ms").join(side(8, "fast_ms"), "vertices")


@add("SELECT event_type, round(avg((user_id % 2 = 0)::INT), 9) AS accuracy, round(avg(value), 6) AS loss FROM events GROUP BY event_type")
def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy and loss per batch."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(rounded(F.avg((F.col("user_id") % 2 == 0).cast("double")), 9).alias("accuracy"), rounded(F.avg("value")).alias("loss"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a program's output, one per event: a timing, an accuracy, a device's share or something else, by turns."""
    e = table(spark, d, "events")
    tail = F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, F.concat(F.lit("[Timing] "), F.col("event_type"), F.lit(": "), tail, F.lit(".5 ms"))).when(kind == 1, F.concat(F.lit("Accuracy: "), tail, F.lit(".25 %"))).when(kind == 2, F.concat(F.lit("CPU "), tail)).otherwise(F.concat(F.lit("done "), tail))
    return e.select(line.alias("value"))


@add("SELECT event_type AS phase, user_id + 0.5::DOUBLE AS ms FROM events WHERE event_id % 4 = 0")
def timing_line_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_timings(_log(spark, d))


@add("SELECT round((user_id + 0.25::DOUBLE) / 100, 9) AS accuracy FROM events WHERE event_id % 4 = 1")
def accuracy_line_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_accuracy(_log(spark, d)).select(rounded(F.col("accuracy"), 9).alias("accuracy"))


@add("SELECT 'CPU' AS device, user_id::BIGINT AS vertices FROM events WHERE event_id % 4 = 2")
def device_line_parse(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_device(_log(spark, d))
