"""Queries of the graph operators, over the co-purchase graph, and of sampling and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.portable import portable_hash_sql, rounded
from lodestone.operators import forest
from lodestone.operators import graph as G
from lodestone.operators import learning as L
from lodestone.operators.endtoend import analyse
from lodestone.operators.numeric import zscore
from lodestone.plans.tables import Registry, table
from lodestone.sources import graphs as S

REGISTRY = Registry()
add = REGISTRY.add
LEVELS, SOURCES, ROUNDS = 20, 8, 10
_BASE = """l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 40),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
arcs AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
vs AS MATERIALIZED (SELECT unnest(range((SELECT max(l_partkey) + 1 FROM lineitem))) AS v),
deg AS MATERIALIZED (SELECT v, count(src) AS deg FROM vs LEFT JOIN arcs ON v = src GROUP BY v),
n AS (SELECT count(*) AS n FROM vs)"""
_graph = S.copurchase_graph


def _settled(spark: SparkSession, d: str) -> S.Graph:
    """The graph with its arcs written once, for queries that pass over them several times."""
    return G.settled(_graph(spark, d))


@add(f"WITH {_BASE} SELECT count(*) AS n_vertices, sum(deg)::BIGINT AS n_arcs, count(*) FILTER (deg = 0) AS isolated, max(deg) AS max_degree FROM deg")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(_graph(spark, d))


@add("SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, l_quantity FROM lineitem")
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return S.symmetrize(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


@add("SELECT l_partkey AS src, l_suppkey AS dst, min(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.dedup_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


@add(f"WITH {_BASE} SELECT v, (sum(deg) OVER (ORDER BY v) - deg)::BIGINT AS row_start, (sum(deg) OVER (ORDER BY v))::BIGINT AS row_end FROM deg")
def csr_row_ptr(spark: SparkSession, d: str) -> DataFrame:
    return G.row_offsets(_graph(spark, d))


@add(f"WITH {_BASE} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS position FROM arcs")
def csr_positions(spark: SparkSession, d: str) -> DataFrame:
    return G.arc_positions(_graph(spark, d))


@add(f"WITH {_BASE} SELECT v, deg / (n - 1)::DOUBLE AS degree_centrality FROM deg, n")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_centrality(_graph(spark, d))


@add(f"""WITH {_BASE}, i AS (SELECT dst, count(*) AS k FROM e GROUP BY dst), o AS (SELECT src, count(*) AS k FROM e GROUP BY src)
SELECT v, coalesce(i.k, 0) / (n - 1)::DOUBLE AS in_degree, coalesce(o.k, 0) / (n - 1)::DOUBLE AS out_degree, (coalesce(i.k, 0) + coalesce(o.k, 0)) / (2 * (n - 1))::DOUBLE AS total_degree
FROM vs LEFT JOIN i ON v = i.dst LEFT JOIN o ON v = o.src, n""")
def degree_directed(spark: SparkSession, d: str) -> DataFrame:
    lineitem = table(spark, d, "lineitem")
    n = lineitem.agg(F.max("l_partkey")).first()[0] + 1
    return G.degree_centrality(S.Graph.from_edges(S.copurchase_edges(lineitem), directed=True, n=n, checked=True))


_TRI = "tri AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst)"


@add(f"WITH {_BASE}, {_TRI} SELECT count(*) AS triangles FROM tri")
def triangle_count(spark: SparkSession, d: str) -> DataFrame:
    return G.triangles(_settled(spark, d)).agg(F.count("*").alias("triangles"))


_CLUSTER = f"{_TRI}, t AS (SELECT v, count(*) AS k FROM (SELECT unnest([x, y, z]) AS v FROM tri) GROUP BY v), cl AS (SELECT deg.v, CASE WHEN deg < 2 THEN 0.0 ELSE coalesce(k, 0) / (deg * (deg - 1) / 2.0::DOUBLE) END AS clustering FROM deg LEFT JOIN t ON deg.v = t.v)"


@add(f"WITH {_BASE}, {_CLUSTER} SELECT v, round(clustering, 9) AS clustering FROM cl")
def clustering_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return G.clustering_coefficient(_settled(spark, d)).select("v", rounded(F.col("clustering"), 9).alias("clustering"))


def _rank_sql(rounds: int = ROUNDS) -> str:
    out = "p0 AS (SELECT v, deg, 1.0::DOUBLE / n AS pr FROM deg, n)"
    for k in range(1, rounds + 1):
        p = f"p{k - 1}"
        out += f""", b{k} AS (SELECT 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(pr), 0) FROM {p} WHERE deg = 0) / n AS base FROM n),
p{k} AS MATERIALIZED (SELECT q.v, q.deg, base + 0.85::DOUBLE * coalesce(got, 0) AS pr FROM {p} q LEFT JOIN (SELECT dst, sum(pr / deg) AS got FROM arcs JOIN {p} ON src = v GROUP BY dst) s ON s.dst = q.v, b{k})"""
    return out


@add(f"WITH {_BASE}, {_rank_sql()} SELECT v, round(pr, 9) AS pagerank FROM p{ROUNDS}")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(_graph(spark, d), tolerance=0.0, max_iter=ROUNDS).select("v", rounded(F.col("pagerank"), 9).alias("pagerank"))


def _bfs_sql() -> str:
    out = f"s AS (SELECT v FROM vs ORDER BY {portable_hash_sql('v', 42)}, v LIMIT {SOURCES}), f0 AS (SELECT v AS source, v, 1.0::DOUBLE AS sigma FROM s)"
    return f"{out}, {_levels_sql()}"


def _levels_sql() -> str:
    out = []
    for k in range(1, LEVELS + 1):
        back = " ".join(f"AND NOT EXISTS (SELECT 1 FROM f{j} o WHERE o.source = f.source AND o.v = a.dst)" for j in (k - 1, k - 2) if j >= 0)
        out.append(f"f{k} AS MATERIALIZED (SELECT f.source, a.dst AS v, sum(f.sigma) AS sigma FROM f{k - 1} f JOIN arcs a ON a.src = f.v WHERE true {back} GROUP BY 1, 2)")
    return ", ".join(out)


_ALL = " UNION ALL ".join(f"SELECT source, v, {k}::BIGINT AS level, sigma FROM f{k}" for k in range(LEVELS + 1))


@add(f"WITH {_BASE}, {_bfs_sql()} {_ALL}")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """From sampled sources."""
    g = _graph(spark, d)
    return G.bfs_levels(g, G.sample_vertices(g, SOURCES))


def _between_sql() -> str:
    out = f"d{LEVELS} AS (SELECT source, v, sigma, 0.0::DOUBLE AS delta FROM f{LEVELS})"
    for k in range(LEVELS - 1, -1, -1):
        out += f", d{k} AS MATERIALIZED (SELECT f.source, f.v, f.sigma, coalesce(sum(f.sigma / b.sigma * (1 + b.delta)), 0.0) AS delta FROM f{k} f LEFT JOIN (SELECT a.src, b.source, b.sigma, b.delta FROM d{k + 1} b JOIN arcs a ON a.dst = b.v) b ON b.src = f.v AND b.source = f.source GROUP BY f.source, f.v, f.sigma)"
    whole = " UNION ALL ".join(f"SELECT source, v, delta FROM d{k}" for k in range(LEVELS + 1))
    return f"{out}, w AS (SELECT v, sum(delta) AS raw FROM ({whole}) WHERE v <> source GROUP BY v)"


@add(f"WITH {_BASE}, {_bfs_sql()}, {_between_sql()} SELECT vs.v, round(coalesce(raw, 0) / ((n - 1) * (n - 2) * 0.5::DOUBLE * {SOURCES} / n), 6) AS betweenness FROM vs LEFT JOIN w ON vs.v = w.v, n")
def betweenness_sampled(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(_graph(spark, d), SOURCES).select("v", rounded(F.col("betweenness"), 6).alias("betweenness"))


_SOME = """l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 49),
e AS (SELECT DISTINCT a.l_partkey % 200 AS src, b.l_partkey % 200 AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey % 200 < b.l_partkey % 200),
arcs AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
vs AS MATERIALIZED (SELECT unnest(range(200)) AS v), n AS (SELECT 200 AS n), s AS (SELECT v FROM vs), f0 AS (SELECT v AS source, v, 1.0::DOUBLE AS sigma FROM s)"""


@add(f"WITH {_SOME}, {_levels_sql()}, {_between_sql()} SELECT vs.v, round(coalesce(raw, 0) / ((n - 1) * (n - 2) * 0.5::DOUBLE), 6) AS betweenness FROM vs LEFT JOIN w ON vs.v = w.v, n")
def betweenness_all(spark: SparkSession, d: str) -> DataFrame:
    """From all sources, over a graph of 200 groups of parts, joined where an order holds large quantities of both."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("l_partkey"), "l_quantity")
    g = S.Graph.from_edges(S.copurchase_edges(lines, 49.0), n=200, checked=True)
    return G.betweenness(g).select("v", rounded(F.col("betweenness"), 6).alias("betweenness"))


def _features(g: S.Graph) -> DataFrame:
    return G.extract_features(g, [G.degree_centrality, lambda x: G.pagerank(x, tolerance=0.0, max_iter=ROUNDS), G.clustering_coefficient])


@add(f"WITH {_BASE}, {_CLUSTER}, {_rank_sql()} SELECT deg.v, round(deg.deg / (n - 1)::DOUBLE, 9) AS degree_centrality, round(pr, 9) AS pagerank, round(clustering, 9) AS clustering FROM deg JOIN p{ROUNDS} p ON p.v = deg.v JOIN cl ON cl.v = deg.v, n")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = _features(_settled(spark, d))
    return f.select("v", *(rounded(F.col(c), 9).alias(c) for c in ("degree_centrality", "pagerank", "clustering")))


_LABEL = "lab AS (SELECT v, ((row_number() OVER (ORDER BY deg, v) - 1) * 5 // n)::BIGINT AS label FROM deg, n)"


@add(f"WITH {_BASE}, {_LABEL} SELECT v, label FROM lab")
def label_bins(spark: SparkSession, d: str) -> DataFrame:
    return G.label_bins(G.degrees(_graph(spark, d)), "deg")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Vertex features as z-scores, with labels by degree."""
    g = _settled(spark, d)
    scaled = zscore(_features(g), ["degree_centrality", "pagerank", "clustering"])
    return scaled.join(G.label_bins(G.degrees(g), "deg"), "v")


@add(f"WITH {_BASE} SELECT v, round(ln(1 + deg), 9) AS score FROM deg")
def log_degree_scores(spark: SparkSession, d: str) -> DataFrame:
    return G.log_degree(_graph(spark, d)).select("v", rounded(F.col("score"), 9).alias("score"))


@add(None)
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """From lines to evaluation: graph, four features (betweenness from all sources, PageRank until it changes by less than 1e-6), z-scores, labels by degree, a forest of 50 trees and its accuracy and macro means on a held-out fifth."""
    return analyse(lambda: _graph(spark, d), samples=0).metrics()


@add(f"WITH {_BASE} SELECT v, deg, CASE WHEN deg > 8 THEN 'cpu' ELSE 'gpu' END AS side FROM deg")
def workload_split(spark: SparkSession, d: str) -> DataFrame:
    return G.workload_split(_graph(spark, d), 8)


@add(f"WITH {_BASE} SELECT v, deg, CASE WHEN deg > 32 THEN 'cpu' ELSE 'gpu' END AS side FROM deg")
def workload_split_default(spark: SparkSession, d: str) -> DataFrame:
    return G.workload_split(_graph(spark, d))


@add(f"""WITH {_BASE}, k AS (SELECT least(n, greatest(100, n // 100)) AS k FROM n), r AS (SELECT v, deg, row_number() OVER (ORDER BY {portable_hash_sql('v', 42)}, v) - 1 AS i FROM deg),
m AS (SELECT deg, row_number() OVER (ORDER BY deg, v) - 1 AS i FROM r, k WHERE r.i < k) SELECT greatest(4, 2 * deg) AS threshold FROM m, k WHERE i = k // 2""")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    return G.adaptive_threshold(_graph(spark, d))


_HASHED = f"r AS (SELECT doc_id, row_number() OVER (ORDER BY {portable_hash_sql('doc_id', 42)}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"


@add(f"WITH {_HASHED} SELECT doc_id, i >= n - floor(n * 0.2)::BIGINT AS is_test FROM r")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return G.train_test_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@add(f"WITH {_HASHED} SELECT doc_id, (i >= n // 5)::BIGINT + (i >= 2 * n // 5)::BIGINT + (i >= 3 * n // 5)::BIGINT + (i >= 4 * n // 5)::BIGINT AS fold FROM r")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return G.kfold(table(spark, d, "documents").select("doc_id"), "doc_id")


@add("SELECT l_linenumber, round(1 - sum(n * n) / power(sum(n), 2), 9) AS gini FROM (SELECT l_linenumber, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def gini_impurity(spark: SparkSession, d: str) -> DataFrame:
    return L.gini(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag").select("l_linenumber", rounded(F.col("gini"), 9).alias("gini"))


@add("SELECT l_linenumber, l_returnflag FROM (SELECT l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC, l_returnflag) AS i FROM lineitem GROUP BY 1, 2) WHERE i = 1")
def majority_class(spark: SparkSession, d: str) -> DataFrame:
    return L.majority(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag")


_SPLIT = """f AS (SELECT 0 AS pos, 'l_quantity' AS feature, l_quantity AS x, l_returnflag AS y FROM lineitem UNION ALL SELECT 1, 'l_discount', l_discount, l_returnflag FROM lineitem UNION ALL SELECT 2, 'l_tax', l_tax, l_returnflag FROM lineitem),
g AS (SELECT pos, feature, x, c.y, count(*) FILTER (f.y = c.y)::DOUBLE AS n FROM f, (SELECT DISTINCT l_returnflag AS y FROM lineitem) c GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, y ORDER BY x) AS l, sum(n) OVER (PARTITION BY feature, y) AS t FROM g),
s AS (SELECT pos, feature, x, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS l2, sum((t - l) * (t - l)) AS r2, sum(t * t) AS t2 FROM w GROUP BY ALL),
c AS (SELECT *, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS threshold FROM s)"""
_BEST = "b AS (SELECT feature, threshold, (l2 / nl + r2 / nr) / (nl + nr) - t2 / power(nl + nr, 2) AS gain FROM c WHERE threshold IS NOT NULL ORDER BY round((l2 / nl + r2 / nr) / (nl + nr) - t2 / power(nl + nr, 2), 12) DESC, pos, threshold LIMIT 1)"


@add(f"WITH {_SPLIT}, {_BEST} SELECT feature, round(threshold, 9) AS threshold, round(gain, 9) AS gain FROM b")
def best_split(spark: SparkSession, d: str) -> DataFrame:
    s = L.best_split(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return s.select("feature", rounded(F.col("threshold"), 9).alias("threshold"), rounded(F.col("gain"), 9).alias("gain"))


def _stump(spark: SparkSession, d: str) -> tuple[L.Forest, DataFrame]:
    """One tree of one split over all features and rows: the class of a line by its quantity, discount and tax."""
    names = F.array(*map(F.lit, "ANR"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_SPLIT_BY, (F.array_position(names, F.col("l_returnflag")) - 1).cast("long").alias("label"))
    return L.Forest(trees=1, max_depth=1, bootstrap=None, features=len(_SPLIT_BY)).fit(lines, _SPLIT_BY, "label", 3), lines


_SPLIT_BY = ["l_quantity", "l_discount", "l_tax"]
_SIDE = "CASE feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END <= threshold"


@add(f"""WITH {_SPLIT}, {_BEST}, side AS (SELECT lineitem.*, {_SIDE} AS lower FROM lineitem, b), m AS (SELECT lower, l_returnflag, row_number() OVER (PARTITION BY lower ORDER BY count(*) DESC, l_returnflag) AS i FROM side GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, strpos('ANR', m.l_returnflag)::BIGINT - 1 AS y_pred, 1.0::DOUBLE AS share FROM side JOIN m USING (lower) WHERE i = 1""")
def tree_stump(spark: SparkSession, d: str) -> DataFrame:
    model, lines = _stump(spark, d)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return model.predict(lines, keys).select(*keys, "y_pred", F.array_max("probabilities").alias("share"))


@add(f"WITH {_SPLIT}, {_BEST} SELECT x.feature, (x.feature = b.feature)::INT::DOUBLE AS importance FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) x(feature), b")
def feature_importances(spark: SparkSession, d: str) -> DataFrame:
    shares = _stump(spark, d)[0].importances()
    return spark.createDataFrame(list(shares.items()), "feature string, importance double")


_LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LINE_NUMBER = "l_orderkey * 8 + l_linenumber"


def _tree_sql(name: str, rows: str, weight: str, depth: int, classes: int = 3, min_leaf: int = 5) -> str:
    """CTEs up to `name`: all columns of rows (among them _SPLIT_BY and y) and p, the class of the leaf in a tree grown on rows drawn `weight` times."""
    out = f"{name}0 AS MATERIALIZED (SELECT *, {weight} AS w, 1::BIGINT AS node FROM {rows})"
    for k in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {i} AS pos, {f}::DOUBLE AS x, y, w FROM {name}{k} WHERE w > 0" for i, f in enumerate(_SPLIT_BY))
        out += f""",
{name}g{k} AS (SELECT node, pos, x, c.y, sum(CASE WHEN f.y = c.y THEN w ELSE 0 END)::DOUBLE AS n FROM ({long}) f, range({classes}) c(y) GROUP BY ALL),
{name}w{k} AS (SELECT *, sum(n) OVER (PARTITION BY node, pos, y ORDER BY x) AS l, sum(n) OVER (PARTITION BY node, pos, y) AS t FROM {name}g{k}),
{name}s{k} AS (SELECT node, pos, x, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS l2, sum((t - l) * (t - l)) AS r2, sum(t * t) AS t2, max(t) AS most FROM {name}w{k} GROUP BY ALL),
{name}c{k} AS (SELECT *, nl + nr AS n, (x + lead(x) OVER (PARTITION BY node, pos ORDER BY x)) / 2 AS threshold FROM {name}s{k}),
{name}q{k} AS (SELECT *, round((l2 / nl + r2 / nr) / n - t2 / (n * n), 12) AS gain FROM {name}c{k} WHERE threshold IS NOT NULL AND n > {min_leaf} AND most < n),
{name}b{k} AS MATERIALIZED (SELECT node, pos, threshold FROM {name}q{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, pos, threshold) = 1),
{name}{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.pos IS NULL THEN r.node ELSE 2 * r.node + (CASE b.pos {" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_SPLIT_BY))} END > threshold)::BIGINT END AS node FROM {name}{k} r LEFT JOIN {name}b{k} b USING (node))"""
    return out + f""",
{name}m AS (SELECT node, y AS p FROM {name}{depth} WHERE w > 0 GROUP BY node, y QUALIFY row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, y) = 1),
{name} AS (SELECT r.*, p FROM {name}{depth} r JOIN {name}m USING (node))"""


def _drawn_sql(tree: int, share: float = 0.8, seed: int = 42) -> str:
    h = portable_hash_sql(_LINE_NUMBER, forest.tree_seed(seed, tree))
    return f"(SELECT list_sum(list_transform({forest.poisson_steps(share)}, lambda s: (h >= s)::BIGINT)) FROM (SELECT {h} AS h))"


_FLAGGED = f"lines AS MATERIALIZED (SELECT row_number() OVER () AS i, {', '.join(_LINE_KEYS)}, l_quantity, l_discount, l_tax, strpos('ANR', l_returnflag)::BIGINT - 1 AS y FROM lineitem)"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, "ANR"))
    return table(spark, d, "lineitem").select(*_LINE_KEYS, *_SPLIT_BY, F.expr(_LINE_NUMBER).alias("number"), (F.array_position(names, F.col("l_returnflag")) - 1).cast("long").alias("label"))


@add(f"WITH {_FLAGGED}, {_tree_sql('t', 'lines', _drawn_sql(0), 4)} SELECT {', '.join(_LINE_KEYS)}, p AS y_pred FROM t")
def tree_depth_four(spark: SparkSession, d: str) -> DataFrame:
    """The class of every line by a tree of four levels, grown on a bootstrap sample of all lines."""
    lines = _flagged(spark, d)
    model = L.Forest(trees=1, max_depth=4, features=len(_SPLIT_BY)).fit(lines, _SPLIT_BY, "label", 3, "number")
    return model.predict(lines, _LINE_KEYS).select(*_LINE_KEYS, "y_pred")


_VOTES = ", ".join(f"v{t} AS (SELECT i, {', '.join(_LINE_KEYS)}, p FROM t{t}x)" for t in range(3))
_BALLOT = " UNION ALL ".join(f"SELECT * FROM v{t}" for t in range(3))


@add(f"""WITH {_FLAGGED}, {", ".join(_tree_sql(f"t{t}x", "lines", _drawn_sql(t), 3) for t in range(3))}, {_VOTES},
n AS (SELECT i, {", ".join(_LINE_KEYS)}, p, count(*) AS n FROM ({_BALLOT}) GROUP BY ALL)
SELECT {", ".join(_LINE_KEYS)}, p AS y_pred, round(n / sum(n) OVER (PARTITION BY i), 9) AS share FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, p) = 1""")
def forest_votes(spark: SparkSession, d: str) -> DataFrame:
    """The class that most of three trees give a line, and the share of them."""
    lines = _flagged(spark, d)
    model = L.Forest(trees=3, max_depth=3, features=len(_SPLIT_BY)).fit(lines, _SPLIT_BY, "label", 3, "number")
    return model.predict(lines, _LINE_KEYS).select(*_LINE_KEYS, "y_pred", rounded(F.array_max("probabilities"), 9).alias("share"))


_FOLDED = f"""lines AS (SELECT l_quantity, l_discount, l_tax, {_LINE_NUMBER} AS number, (l_quantity >= 30)::BIGINT + (l_discount >= 0.06 AND l_linenumber <> 3)::BIGINT AS y FROM lineitem),
placed AS (SELECT *, row_number() OVER (ORDER BY {portable_hash_sql("number", 42)}, number) - 1 AS i, count(*) OVER () AS n FROM lines),
folded AS (SELECT * EXCLUDE (i, n), (i >= n // 5)::BIGINT + (i >= 2 * n // 5)::BIGINT + (i >= 3 * n // 5)::BIGINT + (i >= 4 * n // 5)::BIGINT AS fold FROM placed)"""
_JUDGED = " UNION ALL ".join(f"SELECT y, p FROM f{f}x WHERE fold = {f}" for f in range(5))


@add(f"WITH {_FOLDED}, {', '.join(_tree_sql(f'f{f}x', 'folded', f'(fold <> {f})::BIGINT', 2) for f in range(5))} SELECT y AS y_true, p AS y_pred, count(*) AS n FROM ({_JUDGED}) GROUP BY 1, 2")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Lines by class and by the class that trees of two levels, grown on the four other folds, give them."""
    label = (F.col("l_quantity") >= 30).cast("long") + ((F.col("l_discount") >= 0.06) & (F.col("l_linenumber") != 3)).cast("long")
    lines = table(spark, d, "lineitem").select(*_SPLIT_BY, F.expr(_LINE_NUMBER).alias("number"), label.alias("label"))
    pairs = L.cross_validate(lines, "number", _SPLIT_BY, "label", 3, trees=1, max_depth=2, bootstrap=None, features=len(_SPLIT_BY))
    return pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


_PAIRS = "p AS (SELECT quality::BIGINT AS y_true, (n_chars > 1500)::BIGINT AS y_pred FROM labels JOIN documents USING (doc_id)), g AS (SELECT a.k AS y_true, b.k AS y_pred FROM range(2) a(k), range(2) b(k))"
_CONF = f"{_PAIRS}, c AS (SELECT g.y_true, g.y_pred, count(p.y_true) AS n FROM g LEFT JOIN p ON p.y_true = g.y_true AND p.y_pred = g.y_pred GROUP BY 1, 2)"
_CLASS = f"""{_CONF}, m AS (SELECT k AS class, sum(n) FILTER (y_true = k AND y_pred = k) AS tp, sum(n) FILTER (y_true = k) AS support, sum(n) FILTER (y_pred = k) AS predicted FROM c, range(2) r(k) GROUP BY k),
q AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support::BIGINT AS support FROM m),
z AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM q)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Quality against a guess by length."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("long").alias("y_pred"))
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").cast("long").alias("y_true"), "y_pred")


@add(f"WITH {_CONF} SELECT * FROM c")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.confusion(_predicted(spark, d), 2)


@add(f"WITH {_CLASS} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM z")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return L.per_class(_predicted(spark, d), 2).select("class", *(rounded(F.col(c), 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@add(f"WITH {_CLASS} SELECT class, printf('%d %.4f %.4f %.4f %d', class, precision, recall, f1, support) AS line FROM z")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.format_report(L.per_class(_predicted(spark, d), 2))


@add(f"WITH {_CLASS} SELECT (SELECT round(avg((y_true = y_pred)::INT), 9) FROM p) AS accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM z")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = L.macro(_predicted(spark, d), 2)
    return m.select(*(rounded(F.col(c), 9).alias(c) for c in m.columns))


@add(None)
def rf_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A forest that tells a vertex's degree class from its PageRank and clustering: accuracy and macro means on a held-out fifth."""
    g = _settled(spark, d)
    data = cut(G.train_test_split(G.extract_features(g, [lambda x: G.pagerank(x, tolerance=0.0, max_iter=ROUNDS), G.clustering_coefficient]).join(G.label_bins(G.degrees(g), "deg"), "v"), "v"))
    model = L.Forest(trees=30, max_depth=10).fit(data.filter("NOT is_test"), ["pagerank", "clustering"], "label", 5)
    return L.macro(model.predict(data.filter("is_test"), ["label"]).select(F.col("label").alias("y_true"), "y_pred"), 5)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Edge-list text with comments and junk, one line per order line."""
    pair = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.lit("x"))
    return table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("# "), pair)).when(F.col("l_linenumber") == 2, F.lit("3,4")).otherwise(pair).alias("value"))


@add("SELECT l_partkey AS src, l_suppkey AS dst, 0.0::DOUBLE AS weight FROM lineitem WHERE l_linenumber > 2")
def edge_list_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.parse_edge_lines(_lines(spark, d), weighted=True)


@add(f"SELECT a.k AS src, b.k AS dst FROM range(400) a(k) JOIN range(400) b(k) ON a.k < b.k WHERE {portable_hash_sql('a.k * 1000003 + b.k', 42)} < 0.05::DOUBLE * 2147483648")
def er_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.Graph.erdos_renyi(spark, 400, 0.05).arcs.filter("src < dst").select("src", "dst")


@add(None)
def ba_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.Graph.barabasi_albert(spark, 1000, 3).arcs


@add(f"WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), d AS (SELECT id AS draw, {portable_hash_sql('id', 42)} % (SELECT count(*) FROM customer) AS i FROM range((SELECT floor(count(*) * 0.8)::BIGINT FROM customer)) t(id)) SELECT draw, c_custkey, c_acctbal FROM d JOIN r USING (i)")
def bootstrap_sample(spark: SparkSession, d: str) -> DataFrame:
    return G.bootstrap(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")


@add("SELECT o_orderkey AS at, c_custkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey")
def gather_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("c_custkey"))
    return G.gather(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", orders)


@add(f"WITH {_HASHED} SELECT doc_id FROM r WHERE NOT (i >= 0 AND i < n // 5)")
def fold_except(spark: SparkSession, d: str) -> DataFrame:
    """The training rows of fold 0: all but the fold."""
    docs = table(spark, d, "documents").select("doc_id")
    held = G.kfold(docs, "doc_id").filter("fold = 0")
    return docs.join(held, "doc_id", "left_anti")
