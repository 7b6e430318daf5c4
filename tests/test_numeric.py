import random
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import lineage
from lodestone.operators import learning as L
from lodestone.operators import numeric as N
from lodestone.operators import runs as R
from lodestone.operators.sequences import align_above, smith_waterman
from lodestone.operators.tiles import conv_rows, conv_tiles
from lodestone.sources import generators
from lodestone.streaming.results import stream_results


def test_zscore_of_four(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert [r.x for r in N.zscore(df, ["x"]).orderBy("x").collect()] == pytest.approx([-1.341641, -0.447214, 0.447214, 1.341641], abs=1e-5)
    same = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert {r.x for r in N.minmax(same, ["x"]).collect()} == {0.0}


def test_known_numbers(spark):
    assert N.primes(spark, 200).count() == 46
    assert [r.n for r in N.perfect_numbers(spark, 10000).orderBy("n").collect()] == [6, 28, 496, 8128]
    assert N.pi_integral(spark, 100000).first().pi == pytest.approx(3.14159265, abs=1e-8)
    ones = spark.range(9).select(F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).alias("j"), F.lit(1.0).alias("x"))
    assert {r.x for r in N.matmul(ones, ones).collect()} == {3.0}


def test_correlation_against_numpy(spark):
    a = np.random.default_rng(1).normal(size=(40, 5))
    a[:, 4] = 3.0
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(5)], "i long, j long, x double")
    got = {(r.i, r.j): r.r for r in N.correlation_matrix(cells, 5).collect()}
    want = np.corrcoef(a[:, :4], rowvar=False)
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(4) for j in range(i + 1))
    assert got[4, 4] is None


def test_softmax_and_losses(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "x array<double>, y int")
    p = row.select(N.softmax(F.col("x")).alias("p"), N.cross_entropy(F.col("x"), F.col("y")).alias("l"), N.argmax(F.col("x")).alias("a")).first()
    e = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert p.p == pytest.approx(list(e)) and p.l == pytest.approx(-np.log(e[2])) and p.a == 2


def test_pool_drops_odd_edges(spark):
    cells = spark.range(9).select(F.lit(0).alias("n"), F.floor(F.col("id") / 3).alias("h"), (F.col("id") % 3).alias("w"), F.col("id").cast("double").alias("x"))
    assert [tuple(r) for r in N.max_pool(cells, 3, 3).collect()] == [(0, 0, 0, 4.0)]


def test_forces_balance(spark):
    p = spark.createDataFrame([(i, float(i), i * 0.3, 0.1 * i * i) for i in range(6)], "id long, x double, y double, z double")
    f = N.forces(p, 2).collect()
    assert len(f) == 6 and sum(r.fx for r in f) == pytest.approx(0, abs=1e-9)


def test_energy_and_forces_by_blocks_form_no_row_per_pair(spark):
    r = random.Random(3)
    rows = [(i, r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)) for i in range(300)] + [(300, 1.0, 1.0, 1.0), (301, 1.0, 1.0, 1.0), (302, None, 1.0, 1.0), (5, 20.0, 20.0, 20.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    pairs = N.lennard_jones(p)
    one = {f.id: (f.fx, f.fy, f.fz) for f in N._both_ways(pairs).collect()}
    for blocks in (1, 3, None):
        assert N.energy(p, blocks).first()[0] == pytest.approx(pairs.agg(F.sum("energy")).first()[0])
        two = {f.id: (f.fx, f.fy, f.fz) for f in N.forces(p, blocks).collect()}
        assert two.keys() == one.keys() and two.pop(302) == (None,) * 3 and all(two[k] == pytest.approx(one[k]) for k in two)
    spot = p.filter("id IN (300, 301)")
    assert N.energy(spot).first()[0] is None and [f.fx for f in N.forces(spot).collect()] == [None, None]
    assert N.forces(p.filter("id = 1")).count() == 0 and N.energy(p.filter("false")).first()[0] is None
    # 40,000 particles in all have 800 million pairs, of which none may become a row
    many = spark.range(40_000).select("id", (F.col("id") % 40 * 1.5).alias("x"), (F.floor(F.col("id") / 40) % 40 * 1.5).alias("y"), (F.floor(F.col("id") / 1600) * 1.5).alias("z"))
    assert "Join" not in N.energy(many, 10)._jdf.queryExecution().optimizedPlan().toString()


def test_alignments_side_by_side_equal_one_by_one(monkeypatch):
    from lodestone.operators import sequences

    r = random.Random(8)
    some = ["", "a", "\U0001f600b", *("".join(r.choices("abc ", k=r.randint(1, 60))) for _ in range(40))]
    a, b = [x for x in some for _ in some], some * len(some)
    want = [sequences.smith_waterman(x, y) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(sequences, "smith_waterman", None)  # no table of its own for each pair
    for cells in (1, 500, 1 << 16):
        monkeypatch.setattr(sequences, "CELLS", cells)
        assert sequences.smith_waterman_many(a, b).tolist() == want


def test_smith_waterman_by_table():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    r = random.Random(3)
    for _ in range(30):
        a, b = ("".join(r.choices("ACGT", k=r.randint(0, 25))) for _ in range(2))
        assert smith_waterman(a, b) == slow(a, b)


@pytest.mark.parametrize(
    ("true", "pred", "k", "accuracy", "macro"),
    [([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0], 3, 4 / 6, (0.722222, 0.666667, 0.655556)), ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1], 2, 5 / 6, (0.875, 0.833333, 0.828571))],
)
def test_evaluation(spark, true, pred, k, accuracy, macro):
    pairs = spark.createDataFrame(list(zip(true, pred, strict=True)), "y_true long, y_pred long")
    m = L.macro(pairs, k).first()
    assert m.accuracy == pytest.approx(accuracy) and tuple(m)[1:] == pytest.approx(macro, abs=1e-5)
    assert L.confusion(pairs, k).count() == k * k and L.format_report(L.per_class(pairs, k)).count() == k


def linear(n, seed):
    x = np.random.default_rng(seed).random((n, 2))
    return x, (x.sum(1) > 1).astype(int)


def test_tree_and_forest(spark):
    x, y = linear(100, 42)
    assert (L.Cart(features=2).fit(x, y, 2).predict(x) == y).sum() >= 90
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(*linear(400, 42), strict=True))], "id long, x double, y double, label int")
    model = L.Forest(trees=10, max_depth=8, min_leaf=3).fit(df, ["x", "y"], "label", 2)
    assert sum(model.importances().values()) == pytest.approx(1)
    test = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(*linear(100, 999), strict=True)], "x double, y double, label int")
    got = model.predict(test, ["label"]).collect()
    assert sum(r.label == r.y_pred for r in got) >= 75 and all(0 <= p <= 1 for r in got for p in r.probabilities)
    assert L.cross_validate(df, "id", ["x", "y"], "label", 2, folds=2, trees=3).count() == 400


def test_run_analytics(spark):
    rows = [(1, 1, "a", 10.0, 100), (2, 1, "a", 20.0, 100), (3, 2, "a", 5.0, 100), (4, 2, "b", 5.0, 100)]
    df = spark.createDataFrame(rows, "run long, threads long, vertices string, total_ms double, edges long")
    got = {(r.threads, r.vertices): (r.speedup, r.efficiency) for r in R.efficiency(df).collect()}
    assert got == {(1, "a"): (1.0, 1.0), (2, "a"): (3.0, 1.5), (2, "b"): (0.0, 0.0)}
    assert {r.vertices: r.threads for r in R.most_threads(df).collect()} == {"a": 2, "b": 2}


def test_result_lines_and_their_stream(spark, tmp_path):
    (tmp_path / "log.txt").write_text("start\n[RESULT] total_ms=1.5,edges=7\n[Timing] features: 2.25 ms\n")
    lines = spark.read.text(str(tmp_path / "log.txt"))
    assert [tuple(r) for r in R.parse_results(lines, ["edges", "total_ms", "f1"]).collect()] == [(7.0, 1.5, None)]
    assert [tuple(r) for r in R.parse_timings(lines).collect()] == [("features", 2.25)]
    query = stream_results(spark, str(tmp_path), ["edges"]).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.edges for r in spark.table("seen").collect()] == [7.0]


def test_blocked_product(spark):
    r = np.random.default_rng(2)
    a = {(int(i), int(j)): float(x) for i, j, x in zip(r.integers(0, 300, 900), r.integers(0, 260, 900), r.normal(size=900), strict=True)} | {(i, 130): 1.0 for i in range(300)}
    b = {(int(i), int(j)): float(x) for i, j, x in zip(r.integers(0, 260, 900), r.integers(0, 150, 900), r.normal(size=900), strict=True)}
    want = defaultdict(float)
    by_row = defaultdict(list)
    for (k, j), x in b.items():
        by_row[k].append((j, x))
    for (i, k), x in a.items():
        for j, y in by_row[k]:
            want[i, j] += x * y
    frame = lambda m: spark.createDataFrame([(i, j, x) for (i, j), x in m.items()], "i long, j long, x double")
    got = {(c.i, c.j): c.x for c in N.matmul(frame(a), frame(b)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert N.matmul(frame(a), frame(b).filter("false")).count() == 0


def test_split_over_ranges(spark):
    """Values of a feature that lie in many ranges, nulls among the labels, and columns without a second value."""
    r = np.random.default_rng(4)
    rows = [(float(x), float(y), 3.0, "abc"[int(x > 0.3) + int(y > 0.7)] if r.random() < 0.8 else None) for x, y in r.random((400, 2)).round(2)]
    got = L.best_split(spark.createDataFrame(rows, "p double, q double, s double, label string"), ["s", "p", "q"], "label").first()
    best = (0.0, None, None)
    share = lambda ls: sum(c * c for c in Counter(ls).values()) / len(ls)
    for f, at in (("p", 0), ("q", 1)):
        values = sorted({x[at] for x in rows})
        for low, high in zip(values, values[1:], strict=False):
            left, right = [x[3] for x in rows if x[at] <= low], [x[3] for x in rows if x[at] > low]
            gain = (share(left) + share(right)) / len(rows) - share([x[3] for x in rows]) / len(rows)
            if gain > best[0] + 1e-12:
                best = (gain, f, (low + high) / 2)
    assert (got.feature, got.threshold) == best[1:] and got.gain == pytest.approx(best[0])
    assert L.best_split(spark.createDataFrame([], "p double, label string"), ["p"], "label").count() == 0


def test_particles_at_one_place_and_generators(spark):
    two = N.lennard_jones(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0)], "id long, x double, y double, z double")).collect()
    assert {(p.a, p.b): p.energy for p in two} == {(1, 2): None, (1, 3): 0.0, (2, 3): 0.0}
    made = generators.particles(spark, 50).collect()
    assert len(made) == 50 and all(0 <= p[c] < 10 for p in made for c in "xyz") and len({(p.x, p.y, p.z) for p in made}) == 50
    assert {len(s.s) for s in generators.sequences(spark, 5, 30).collect()} == {30} and all(set(s.s) <= set("ACGT") for s in generators.sequences(spark, 5, 30).collect())
    assert [r["count"] for r in generators.two_classes(spark, 10).groupBy("label").count().collect()] == [5, 5]


def test_checkpoint_folder_on_a_cluster():
    """Without a shared folder, a cluster raises an error instead of writing to its machines' own disks."""
    session = MagicMock()
    session.sparkContext.getCheckpointDir.return_value, session.sparkContext.master = None, "spark://host:7077"
    session.conf.get.return_value = None
    with pytest.raises(ValueError, match="share"):
        lineage.checkpoint_dir(session)


def test_stencil_inside_rows_and_on_tiles(spark):
    """Both against sums cell by cell; images of a row need no shuffle."""
    r = np.random.default_rng(3)
    images = r.integers(-4, 5, (3, 21, 13)).astype(float)
    kernel = r.integers(-2, 3, (5, 5)).astype(float).tolist()
    want = np.zeros_like(images)
    for n, h, w in np.ndindex(*images.shape):
        for p, q in np.ndindex(5, 5):
            a, b = h + p - 2, w + q - 2
            if 0 <= a < 21 and 0 <= b < 13:
                want[n, h, w] += kernel[p][q] * images[n, a, b]
    rows = spark.createDataFrame([(n, images[n].ravel().tolist(), "x") for n in range(3)] + [(3, None, "y")], "n long, v array<double>, k string").repartition(2)
    got = conv_rows(rows, "v", kernel, 21, 13)
    assert "Exchange" not in conv_rows(spark.range(5).select(F.array_repeat(F.col("id").cast("double"), 4).alias("v")), "v", kernel, 2, 2)._jdf.queryExecution().executedPlan().toString()
    found = {x.n: x.v for x in got.collect()}
    assert found[3] is None and all(np.allclose(np.array(found[n]).reshape(21, 13), want[n]) for n in range(3))
    cells = spark.createDataFrame([(n, h, w, float(images[n, h, w])) for n, h, w in np.ndindex(*images.shape)], "n long, h long, w long, x double")
    for tile in (2, 4, 7, 64):
        assert {(c.n, c.h, c.w): c.x for c in conv_tiles(cells, kernel, 21, 13, tile).collect()} == pytest.approx({i: want[i] for i in np.ndindex(*images.shape)})
    # cells that aren't there: only where the kernel meets some
    few = conv_tiles(cells.filter("n = 0 AND h = 10 AND w = 6"), kernel, 21, 13, 4).collect()
    assert {(c.h, c.w) for c in few} == {(h, w) for h in range(8, 13) for w in range(4, 9)}
    with pytest.raises(ValueError):
        conv_tiles(cells, kernel, 21, 13, 1)


def test_products_of_tall_matrices(spark):
    x = np.random.default_rng(8).normal(size=(300, 6)) * [1, 10, 0.1, 5, 1, 0] + [1e6, -3, 0, 1e3, 7, 4]
    x[:, 4] = x[:, 0] * 2
    rows = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(5)
    got = {(c.i, c.j): c.x for c in N.gram(rows, "v", 6).collect()}
    ones = np.hstack([x, np.ones((300, 1))])
    assert all(got[i, j] == pytest.approx((ones.T @ ones)[i, j]) for i in range(7) for j in range(i + 1)) and len(got) == 28
    r = {(c.i, c.j): c.r for c in N.correlation_rows(rows, "v", 6).collect()}
    want = np.corrcoef(x[:, :5], rowvar=False)
    assert len(r) == 21 and all(r[5, j] is None for j in range(6)) and all(abs(r[i, j] - want[i, j]) < 1e-9 for i in range(5) for j in range(i + 1))
    assert N.correlation_rows(rows.filter("false"), "v", 6).count() == 0
    plan = N.gram(rows, "v", 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 or plan.count("hashpartitioning") == 1


@pytest.mark.parametrize("crowd", [2000, 7])
def test_pairs_within_a_cutoff(spark, monkeypatch, crowd):
    """The same pairs as of all with all, with cells shared out or not; the bound holds what is left out."""
    monkeypatch.setattr(N, "CELL_ROWS", crowd)
    r = np.random.default_rng(6)
    spots = np.vstack([r.normal(size=(60, 3)) * 4, r.normal(size=(60, 3)) * 0.6 + 9, [[9, 9, 9]] * 2])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(spots)], "id long, x double, y double, z double")
    d = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(122) for j in range(i + 1, 122) if d[i, j] <= 2.5}
    assert sorted((p.a.id, p.b.id) for p in N.near_pairs(df, 2.5).collect()) == sorted(want)
    apart = df.filter("id < 120")
    near, whole = N.lennard_jones_near(apart, 2.5).first(), N.lennard_jones(apart).agg(F.sum("energy")).first()[0]
    assert near.pairs == sum(j < 120 for _, j in want) and abs(whole - near.energy) <= near.left_out < 0.01 * 120 * 120
    wide = {f.id: (f.fx, f.fy, f.fz) for f in N.forces_near(apart, 100.0).collect()}
    assert all(wide[f.id] == pytest.approx((f.fx, f.fy, f.fz)) for f in N.forces(apart).collect()) and len(wide) == 120
    assert N.lennard_jones_near(df.filter("false"), 2.5).first().energy == 0
    with pytest.raises(ValueError):
        N.lennard_jones_near(df, 1.0)


@pytest.mark.parametrize("share", [0.6, 0.8, 0.95])
def test_seeds_miss_no_alignment(spark, share):
    """Against the alignment of all pairs: mutated copies, pieces of others, common and short sequences."""
    r = __import__("random").Random(11)
    texts = ["".join(r.choices("abcd", k=n)) for n in (60, 45, 33, 20, 12, 7, 3, 2, 1)]
    for t in texts[:5]:
        for rate in (0.02, 0.05, 0.1, 0.2):
            texts.append("".join("" if r.random() < rate / 2 else r.choice("abcd") if r.random() < rate else c for c in t))
        texts += [t[3:25], t[::-1], "aaaa" + t[10:30] + "bb"]
    texts += ["a" * 30, "a" * 25 + "b", "ab" * 12, "é" * 9, "", None, "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(3)
    want = {(a, b, smith_waterman(x, y)) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and x and y and smith_waterman(x, y) >= 2 * min(len(x), len(y)) * share - 1e-9}
    got = [tuple(p) for p in align_above(df, share).collect()]
    assert set(got) == want and len(got) == len(want) > 20
