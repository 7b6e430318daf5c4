"""Queries of the element-wise, reduction and matrix operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.portable import portable_hash_sql, rounded
from lodestone.operators import numeric as N
from lodestone.operators.graph import global_rank, running_sums
from lodestone.operators.sequences import align_above, align_pairs
from lodestone.operators.tiles import conv_rows, conv_tiles
from lodestone.plans.tables import Registry, table
from lodestone.sources.generators import closed_form_vectors as closed_form
from lodestone.sources.generators import uniform_matrix as uniform_cells

REGISTRY = Registry()
add = REGISTRY.add
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_KEYS = _LINE.split(", ")


@add(f"SELECT {_LINE}, 2.5 * l_extendedprice + l_quantity AS y FROM lineitem".replace("2.5 *", "2.5::DOUBLE *"))
def daxpy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, N.daxpy(2.5, F.col("l_extendedprice"), F.col("l_quantity")).alias("y"))


@add(f"SELECT {_LINE}, l_extendedprice + l_quantity AS y FROM lineitem")
def vector_add(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, (F.col("l_extendedprice") + F.col("l_quantity")).alias("y"))


@add(f"SELECT {_LINE}, 3.14::DOUBLE * l_quantity AS y FROM lineitem")
def vector_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, (F.lit(3.14) * F.col("l_quantity")).alias("y"))


@add(f"SELECT {_LINE}, (l_extendedprice - l_quantity) * (l_extendedprice - l_quantity) AS y FROM lineitem")
def squared_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, N.squared_diff(F.col("l_extendedprice"), F.col("l_quantity")).alias("y"))


@add("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice + 1 END AS y FROM orders")
def parity_branch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.parity_branch(F.col("o_orderkey"), F.col("o_totalprice")).alias("y"))


_CELLS = "cells AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return N.to_cells(table(spark, d, "embeddings"), "vec_id", "embedding")


@add(f"WITH {_CELLS} SELECT a.i, a.j, a.x + b.x AS x FROM cells a JOIN cells b ON b.i = a.i + 1 AND a.j = b.j WHERE a.i % 2 = 0")
def matrix_add(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the even rows plus that of the odd rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    a, b = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    total = F.zip_with("embedding", "other", lambda x, y: x.cast("double") + y.cast("double"))
    return N.to_cells(a.join(b, "vec_id").select("vec_id", total.alias("v")), "vec_id", "v")


@add(f"""WITH {_CELLS} SELECT i, j, greatest(0.0::DOUBLE, x) AS relu, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(tanh(x), 9) AS tanh,
CASE WHEN x >= 0 THEN x ELSE 0.01::DOUBLE * x END AS leaky, CASE WHEN x > 0 THEN x * x ELSE 0.0 END AS relu_back FROM cells""")
def activations(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _cells(spark, d).select("i", "j", N.relu(x).alias("relu"), rounded(N.sigmoid(x), 9).alias("sigmoid"), rounded(F.tanh(x), 9).alias("tanh"), N.leaky_relu(x).alias("leaky"), N.relu_backward(x, x * x).alias("relu_back"))


@add(f"WITH {_CELLS}, e AS (SELECT i, j, exp(x - max(x) OVER (PARTITION BY i)) AS e FROM cells) SELECT i, j, round(e / sum(e) OVER (PARTITION BY i), 9) AS p FROM e")
def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", N.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return N.to_cells(e, "vec_id", "p").select("i", "j", rounded(F.col("x"), 9).alias("p"))


@add("""SELECT doc_id, round(-(toxic * ln(least(greatest(0.1 + 0.8 * quality, 1e-7), 1 - 1e-7)) + (1 - toxic) * ln(1 - least(greatest(0.1 + 0.8 * quality, 1e-7), 1 - 1e-7))), 9) AS loss
FROM (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels)""")
def bce_loss(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", rounded(N.bce(0.1 + 0.8 * F.col("quality"), F.col("toxic").cast("double")), 9).alias("loss"))


@add(f"""WITH {_CELLS}, m AS (SELECT i, max(x) AS top FROM cells GROUP BY i), s AS (SELECT c.i, any_value(top) AS top, sum(exp(x - top)) AS total FROM cells c JOIN m ON c.i = m.i GROUP BY c.i)
SELECT vec_id, round(-(embedding[label % 10 + 1]::DOUBLE - top) + ln(total), 9) AS loss FROM embeddings JOIN s ON s.i = vec_id""")
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rounded(N.cross_entropy(F.col("embedding").cast("array<double>"), F.col("label") % 10), 9).alias("loss"))


def _adam_sql() -> str:
    """Each dimension's gradient is the next dimension's value, the last one's the first's."""
    out = f"{_CELLS}, s0 AS (SELECT a.i, a.j, a.x AS w, b.x AS g, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM cells a JOIN cells b ON a.i = b.i AND b.j = (a.j + 1) % 64)"
    for t in range(1, 6):
        out += f", t{t} AS (SELECT i, j, w, g, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g AS m, 0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * g * g AS v FROM s{t - 1}), s{t} AS (SELECT i, j, w - 0.001::DOUBLE * (m / (1 - power(0.9::DOUBLE, {t}))) / (sqrt(v / (1 - power(0.999::DOUBLE, {t}))) + 1e-8) AS w, g, m, v FROM t{t})"
    return f"WITH {out} SELECT i AS vec_id, j, round(w, 9) AS w FROM s5"


@add(_adam_sql())
def adam_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("j", "w"))
    g = F.element_at("embedding", (F.col("j") + 1) % F.size("embedding") + 1)
    return N.adam(e.select("vec_id", F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"), g.cast("double").alias("g")), "w", "g").select("vec_id", "j", rounded(F.col("w"), 9).alias("w"))


@add(f"""WITH {_CELLS}, s AS (SELECT j // 16 AS c, avg(x) AS mean, var_pop(x) AS var FROM cells GROUP BY 1)
SELECT i AS n, j // 16 AS c, j % 16 AS hw, round((x - mean) / sqrt(var + 1e-5), 6) AS x FROM cells JOIN s ON s.c = j // 16""")
def batchnorm(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).select(F.col("i").alias("n"), F.floor(F.col("j") / 16).alias("c"), (F.col("j") % 16).alias("hw"), "x")
    return N.batchnorm(c).select("n", "c", "hw", rounded(F.col("x"), 6).alias("x"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(F.col("i").alias("n"), F.floor(F.col("j") / 8).alias("h"), (F.col("j") % 8).alias("w"), "x")


@add(f"WITH {_CELLS} SELECT i AS n, j // 8 // 2 AS h, j % 8 // 2 AS w, max(x) AS x FROM cells GROUP BY 1, 2, 3")
def max_pool(spark: SparkSession, d: str) -> DataFrame:
    return N.max_pool(_images(spark, d), 8, 8)


_KERNEL = ((0.0, 0.125, 0.0), (0.25, 0.5, 0.0625), (0.0, -0.125, 1.0))


@add(f"""WITH {_CELLS}, k(p, q, v) AS (VALUES {", ".join(f"({p}, {q}, {v}::DOUBLE)" for p, r in enumerate(_KERNEL) for q, v in enumerate(r))}),
s AS (SELECT i AS n, j // 8 + 1 - p AS h, j % 8 + 1 - q AS w, x * v AS x FROM cells, k)
SELECT n, h, w, round(sum(x), 9) AS x FROM s WHERE h BETWEEN 0 AND 7 AND w BETWEEN 0 AND 7 GROUP BY n, h, w""")
def conv2d(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an image of 8 x 8."""
    images = conv_rows(table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding"), "embedding", _KERNEL, 8, 8)
    pixels = images.select("n", F.posexplode("embedding").alias("p", "x"))
    return pixels.select("n", F.floor(F.col("p") / 8).alias("h"), (F.col("p") % 8).cast("long").alias("w"), rounded(F.col("x"), 9).alias("x"))


_PLANE = "plane AS (SELECT l_quantity::BIGINT AS h, round(l_discount * 100)::BIGINT AS w, sum(l_extendedprice) / 1000 AS x FROM lineitem GROUP BY 1, 2)"


@add(f"""WITH {_PLANE}, k(p, q, v) AS (VALUES {", ".join(f"({p}, {q}, {v}::DOUBLE)" for p, r in enumerate(_KERNEL) for q, v in enumerate(r))}),
s AS (SELECT h + 1 - p AS h, w + 1 - q AS w, x * v AS x FROM plane, k)
SELECT 0::BIGINT AS n, h, w, round(sum(x), 6) AS x FROM s WHERE h BETWEEN 0 AND 63 AND w BETWEEN 0 AND 15 GROUP BY h, w""")
def conv2d_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Sales by quantity and discount as one image, in tiles of 8 x 8."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("h"), F.round(F.col("l_discount") * 100).cast("long").alias("w")).agg((F.sum("l_extendedprice") / 1000).alias("x")).withColumn("n", F.lit(0).cast("long"))
    return conv_tiles(cells, _KERNEL, 64, 16, tile=8).select("n", "h", "w", rounded(F.col("x")).alias("x"))


@add("SELECT b AS bin, count(l_quantity) AS n FROM range(64) r(b) LEFT JOIN lineitem ON l_quantity::BIGINT = b GROUP BY b")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return N.histogram(table(spark, d, "lineitem"), F.col("l_quantity"), 64)


@add("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem")
def array_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(rounded(F.sum("l_quantity"), 4).alias("total"), rounded(F.avg("l_quantity"), 6).alias("mean"))


@add("SELECT round(sum(l_quantity * l_discount), 3) AS dot FROM lineitem")
def dot_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(rounded(F.sum(F.col("l_quantity") * F.col("l_discount")), 3).alias("dot"))


@add("""SELECT max(o_totalprice) AS high, (SELECT min(o_custkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS high_rank,
min(o_totalprice) AS low, (SELECT min(o_custkey) FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)) AS low_rank FROM orders""")
def min_max_loc(spark: SparkSession, d: str) -> DataFrame:
    """Extremes with the rank that holds them; of ties the lowest rank."""
    top = F.max(F.struct("o_totalprice", (-F.col("o_custkey")).alias("r")))
    low = F.min(F.struct("o_totalprice", F.col("o_custkey").alias("r")))
    return table(spark, d, "orders").agg(top.alias("a"), low.alias("b")).select(F.col("a.o_totalprice").alias("high"), (-F.col("a.r")).alias("high_rank"), F.col("b.o_totalprice").alias("low"), F.col("b.r").alias("low_rank"))


@add("SELECT CAST(sum(i) AS BIGINT) AS total, 1024 * 1025 // 2 AS closed_form FROM range(1, 1025) t(i)")
def series_sum(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 1025).agg(F.sum("id").alias("total")).withColumn("closed_form", F.lit(1024 * 1025 // 2))


@add("SELECT round(sum(4 / (1 + power((i + 0.5::DOUBLE) / 1000000, 2))) / 1000000, 9) AS pi FROM range(1000000) t(i)")
def pi_integral(spark: SparkSession, d: str) -> DataFrame:
    return N.pi_integral(spark, 1_000_000).select(rounded(F.col("pi"), 9).alias("pi"))


@add("SELECT s_suppkey AS rank, CAST(100 + sum(s_suppkey) OVER (ORDER BY s_suppkey) AS BIGINT) AS value FROM supplier")
def ring_sum(spark: SparkSession, d: str) -> DataFrame:
    """A value of 100 goes round the ranks in order, each adding its own."""
    s = running_sums(table(spark, d, "supplier").select(F.col("s_suppkey").alias("rank")), "rank", "rank", "before")
    return s.select("rank", (100 + F.col("before") + F.col("rank")).alias("value"))


@add("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def sort_values(spark: SparkSession, d: str) -> DataFrame:
    return global_rank(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"])


@add(f"WITH {_CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 6) AS x FROM cells a JOIN cells b ON a.i = b.i GROUP BY 1, 2")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """The transposed embedding matrix times itself."""
    c = _cells(spark, d)
    t = c.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")
    return N.matmul(t, c).select("i", "j", rounded(F.col("x"), 6).alias("x"))


@add(f"WITH {_CELLS} SELECT a.j AS i, b.j AS j, round(corr(a.x, b.x), 6) AS r FROM cells a JOIN cells b ON a.i = b.i AND b.j <= a.j GROUP BY 1, 2")
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Of the embedding's dimensions, over all vectors."""
    return N.correlation_rows(table(spark, d, "embeddings"), "embedding", 64).select("i", "j", rounded(F.col("r"), 6).alias("r"))


@add(f"""WITH {_CELLS}, c AS (SELECT label AS k, j, avg(x) AS x FROM cells JOIN embeddings ON vec_id = i GROUP BY 1, 2)
SELECT p.k::BIGINT AS a, q.k::BIGINT AS b, round(sqrt(sum((p.x - q.x) * (p.x - q.x))), 6) AS distance FROM c p JOIN c q ON p.j = q.j AND p.k <= q.k GROUP BY 1, 2""")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Between the mean vectors of all labels."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "x"))
    means = rows.groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda t: t.x).alias("v"))
    return N.distance_matrix(means, "label", "v").select("a", "b", rounded(F.col("distance"), 6).alias("distance"))


_SPOTS = "p AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE * 1.5 AS x, (s_suppkey // 10 % 10)::DOUBLE * 1.5 AS y, (s_suppkey // 100)::DOUBLE * 1.5 + (s_suppkey % 7)::DOUBLE / 16 AS z FROM supplier)"
_PAIR = "d AS (SELECT a.id AS a, b.id AS b, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM p a JOIN p b ON a.id < b.id), e AS (SELECT *, 1 / (dx * dx + dy * dy + dz * dz) AS i2 FROM d)"


def _particles(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers on a slightly shifted lattice."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), ((k % 10) * 1.5).alias("x"), (F.floor(k / 10) % 10 * 1.5).alias("y"), (F.floor(k / 100) * 1.5 + (k % 7) / 16).alias("z"))


@add(f"WITH {_SPOTS}, {_PAIR} SELECT round(sum(4 * i2 * i2 * i2 * (i2 * i2 * i2 - 1)), 6) AS energy FROM e")
def lj_energy(spark: SparkSession, d: str) -> DataFrame:
    return N.energy(_particles(spark, d)).select(rounded(F.col("energy"), 6).alias("energy"))


_CUTOFF = 3.5


@add(f"""WITH {_SPOTS}, {_PAIR}, n AS (SELECT count(*) AS n FROM p), t AS (SELECT count(*) AS pairs, coalesce(sum(4 * i2 * i2 * i2 * (i2 * i2 * i2 - 1)), 0) AS energy FROM e WHERE dx * dx + dy * dy + dz * dz <= {_CUTOFF * _CUTOFF}::DOUBLE)
SELECT pairs, round(energy, 6) AS energy, round((n * (n - 1) / 2 - pairs) * {4 * (_CUTOFF**-6 - _CUTOFF**-12)!r}::DOUBLE, 6) AS left_out FROM t, n""")
def lj_energy_near(spark: SparkSession, d: str) -> DataFrame:
    """Of pairs within a cutoff, found cell by cell."""
    e = N.lennard_jones_near(_particles(spark, d), _CUTOFF)
    return e.select("pairs", rounded(F.col("energy"), 6).alias("energy"), rounded(F.col("left_out"), 6).alias("left_out"))


@add(f"""WITH {_SPOTS}, {_PAIR}, f AS (SELECT a, b, dx, dy, dz, 24 * i2 * i2 * i2 * i2 * (2 * i2 * i2 * i2 - 1) AS s FROM e WHERE dx * dx + dy * dy + dz * dz <= {_CUTOFF * _CUTOFF}::DOUBLE),
g AS (SELECT id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM p UNION ALL SELECT a, s * dx, s * dy, s * dz FROM f UNION ALL SELECT b, -s * dx, -s * dy, -s * dz FROM f)
SELECT id, round(sum(x), 6) + 0.0 AS fx, round(sum(y), 6) + 0.0 AS fy, round(sum(z), 6) + 0.0 AS fz FROM g GROUP BY id""")
def lj_forces_near(spark: SparkSession, d: str) -> DataFrame:
    f = N.forces_near(_particles(spark, d), _CUTOFF)
    return f.select("id", *(rounded(F.col(c), 6).alias(c) for c in ("fx", "fy", "fz")))


@add(f"""WITH {_SPOTS}, {_PAIR}, f AS (SELECT a, b, dx, dy, dz, 24 * i2 * i2 * i2 * i2 * (2 * i2 * i2 * i2 - 1) AS s FROM e),
g AS (SELECT a AS id, s * dx AS x, s * dy AS y, s * dz AS z FROM f UNION ALL SELECT b, -s * dx, -s * dy, -s * dz FROM f)
SELECT id, round(sum(x), 6) + 0.0 AS fx, round(sum(y), 6) + 0.0 AS fy, round(sum(z), 6) + 0.0 AS fz FROM g GROUP BY id""")
def lj_forces(spark: SparkSession, d: str) -> DataFrame:
    f = N.forces(_particles(spark, d))
    return f.select("id", *(rounded(F.col(c), 6).alias(c) for c in ("fx", "fy", "fz")))


def _heat_sql(last: str) -> str:
    out = "h0 AS (SELECT 16 AS i, 16 AS j, 100.0::DOUBLE AS t)"
    for n in range(1, 9):
        moved = " UNION ALL ".join(f"SELECT i + {a} AS i, j + {b} AS j, t / 4 AS t FROM h{n - 1}" for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        out += f", h{n} AS (SELECT i, j, sum(t) AS t FROM ({moved}) WHERE i BETWEEN 1 AND 31 AND j BETWEEN 1 AND 31 GROUP BY i, j)"
    return f"WITH {out} {last}"


@add(_heat_sql("SELECT i::BIGINT AS i, j::BIGINT AS j, t FROM h8"))
def heat_step(spark: SparkSession, d: str) -> DataFrame:
    """A grid of 33 x 33 after 8 steps, warm cells only."""
    return N.heat_steps(N.heat_grid(spark, 33), 33, 8).select("i", "j", "t")


@add(_heat_sql("SELECT sum(t) AS total FROM h8"))
def heat_total(spark: SparkSession, d: str) -> DataFrame:
    return N.heat_steps(N.heat_grid(spark, 33), 33, 8).agg(F.sum("t").alias("total"))


@add("SELECT n FROM range(2, 2001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) u(d) WHERE d * d <= n AND n % d = 0)")
def primes(spark: SparkSession, d: str) -> DataFrame:
    return N.primes(spark, 2000)


@add("SELECT n FROM range(2, 10001) t(n) WHERE n = (SELECT sum(x) FROM range(1, 5001) u(x) WHERE x < n AND n % x = 0)")
def perfect_numbers(spark: SparkSession, d: str) -> DataFrame:
    return N.perfect_numbers(spark, 10000)


@add("SELECT c AS \"column\", round(total, 3) AS total, round(squares, 1) AS squares, low, high FROM (SELECT 'l_quantity' AS c, sum(l_quantity) AS total, sum(l_quantity * l_quantity) AS squares, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_discount', sum(l_discount), sum(l_discount * l_discount), min(l_discount), max(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', sum(l_tax), sum(l_tax * l_tax), min(l_tax), max(l_tax) FROM lineitem)")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    s = N.column_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return s.select("column", rounded(F.col("total"), 3).alias("total"), rounded(F.col("squares"), 1).alias("squares"), "low", "high")


@add(f"WITH {_CELLS}, s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS d FROM cells GROUP BY j) SELECT i AS vec_id, j, round((x - m) / (d + 1e-8), 6) AS x FROM cells JOIN s USING (j)")
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    """Of all dimensions, side by side."""
    names = [f"d{j}" for j in range(64)]
    e = table(spark, d, "embeddings").select("vec_id", *(F.element_at("embedding", j + 1).cast("double").alias(n) for j, n in enumerate(names)))
    long = N.zscore(e, names).select("vec_id", F.posexplode(F.array(*names)).alias("j", "x"))
    return long.select("vec_id", F.col("j").cast("long").alias("j"), rounded(F.col("x")).alias("x"))


@add(f"""WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS r, min(l_extendedprice) AS b, max(l_extendedprice) - min(l_extendedprice) AS q FROM lineitem)
SELECT {_LINE}, round((l_quantity - a) / r, 9) AS l_quantity, round((l_extendedprice - b) / q, 9) AS l_extendedprice FROM lineitem, s""")
def minmax_features(spark: SparkSession, d: str) -> DataFrame:
    m = N.minmax(table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return m.select(*_KEYS, rounded(F.col("l_quantity"), 9).alias("l_quantity"), rounded(F.col("l_extendedprice"), 9).alias("l_extendedprice"))


@add(None)
def smith_waterman(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the benchmark's items, whole texts."""
    return align_pairs(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("s")))


@add(None)
def smith_waterman_above(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the parts' names and types whose alignment scores at least nine tenths of the shorter's best."""
    parts = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("s")).agg(F.min("p_partkey").alias("id"))
    return align_above(parts, 0.9)


@add(f"WITH {_CELLS} SELECT i AS vec_id, CAST(min(j) AS BIGINT) AS argmax FROM cells JOIN (SELECT i AS m, max(x) AS top FROM cells GROUP BY i) ON i = m AND x = top GROUP BY i")
def argmax_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", N.argmax(F.col("embedding")).cast("long").alias("argmax"))


@add("SELECT vec_id, k AS class, (label = k)::INT::DOUBLE AS p FROM embeddings, range(10) r(k)")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Hard class probabilities."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("class")).select("vec_id", "class", (F.col("label") == F.col("class")).cast("double").alias("p"))


@add("SELECT o_orderkey, greatest(100, least(1000000, o_custkey)) AS vertices, greatest(1, least(256, o_orderkey)) AS threads FROM orders")
def clamp(spark: SparkSession, d: str) -> DataFrame:
    held = lambda c, low, high: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), F.col(c)))
    return table(spark, d, "orders").select("o_orderkey", held("o_custkey", 100, 1_000_000).alias("vertices"), held("o_orderkey", 1, 256).alias("threads"))


@add(f"WITH {_CELLS} SELECT i, round(sum(x * x), 6) AS norm2 FROM cells GROUP BY i")
def squared_norms(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("i").agg(rounded(F.sum(F.col("x") * F.col("x")), 6).alias("norm2"))


@add("SELECT round(max(abs(2.5::DOUBLE * l_quantity + l_tax - (l_quantity + l_quantity + l_quantity / 2 + l_tax))), 9) AS worst, round(sum(l_quantity), 4) AS checksum FROM lineitem")
def checksum(spark: SparkSession, d: str) -> DataFrame:
    """The greatest difference between two ways to the same vector, and its checksum."""
    one = N.daxpy(2.5, F.col("l_quantity"), F.col("l_tax"))
    two = F.col("l_quantity") + F.col("l_quantity") + F.col("l_quantity") / 2 + F.col("l_tax")
    return table(spark, d, "lineitem").agg(rounded(F.max(F.abs(one - two)), 9).alias("worst"), rounded(F.sum("l_quantity"), 4).alias("checksum"))


@add(f"SELECT id // 40 AS i, id % 40 AS j, round({portable_hash_sql('id', 42)} / 2147483648.0::DOUBLE, 9) AS x FROM range(4000) t(id)")
def uniform_matrix(spark: SparkSession, d: str) -> DataFrame:
    return uniform_cells(spark, 100, 40).select("i", "j", rounded(F.col("x"), 9).alias("x"))


@add("SELECT id AS i, id * 0.5::DOUBLE AS x, id * 2.0::DOUBLE AS y FROM range(10000) t(id)")
def closed_form_vectors(spark: SparkSession, d: str) -> DataFrame:
    return closed_form(spark, 10000)


@add(f"WITH {_CELLS} SELECT i AS vec_id, j, CASE WHEN {portable_hash_sql('i * 64 + j', 42)} < 0.5::DOUBLE * 2147483648 THEN 0.0 ELSE x / 0.5 END AS x, x AS same FROM cells")
def dropout(spark: SparkSession, d: str) -> DataFrame:
    c, place = _cells(spark, d), F.col("i") * 64 + F.col("j")
    return c.select(F.col("i").alias("vec_id"), "j", N.dropout(place, F.col("x")).alias("x"), N.dropout(place, F.col("x"), training=False).alias("same"))


@add(_heat_sql(" UNION ALL ".join(f"SELECT {n}::BIGINT AS step, round(sum(t), 9) AS total FROM h{n}" for n in range(1, 9))))
def heat_totals(spark: SparkSession, d: str) -> DataFrame:
    return N.heat_totals(N.heat_grid(spark, 33), 33, 8).select("step", rounded(F.col("total"), 9).alias("total"))
