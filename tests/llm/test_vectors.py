"""Product codes and whitening against brute force, on vectors with nulls, gaps, ties, repeated rows and odd lengths."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import codebooks, vectors, whitening
from lodestone.llm.common import sliced

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long, x string, component int"
NAN, INF = float("nan"), float("inf")


def messy(width=8, n=700, seed=3):
    r = random.Random(seed)
    base = [[r.choice((-0.5, -0.25, 0.0, 0.125, 0.5)) + r.gauss(0, 0.01) * (i % 3 == 0) for _ in range(width)] for i in range(n)]
    base[n // 3 : n // 2] = [base[5]] * (n // 2 - n // 3)  # one vector again and again
    out = [(i, v, r.choice((None, 1, 2, 2, 2))) for i, v in enumerate(base)]
    out += [(4, base[9], 1), (4, base[9], 1), (None, base[3], None), (None, base[4], 2)]
    out += [(-5, None, 1), (-4, [], 1), (-3, [1.0] * (width - 1) + [None], 1), (-2, [1.0] * (width - 1) + [NAN], 1), (-1, [INF] + [1.0] * (width - 1), 1), (-6, [1.0] * (width + 1), 1)]
    return [(i, v, y, "clash", 1, "x", 2) for i, v, y in out]


def whole(rows, width):
    return [(r[0], np.array(r[1], dtype=np.float32).astype(float), r[2]) for r in rows if r[1] is not None and len(r[1]) == width and None not in r[1] and np.isfinite(np.array(r[1], dtype=float)).all()]


def lloyd(kept, parts, size, rounds):
    """Every part against every entry, entry by entry."""
    x = [np.floor(1024 * v).astype(int) for _, v, _ in kept]
    w = len(x[0]) // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i].tolist()))[:size]
    books = [[x[i][p * w : (p + 1) * w] for i in order] for p in range(parts)]

    def assign():
        return [[min((int(((v[p * w : (p + 1) * w] - c) ** 2).sum()), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for v, f in zip(x, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = sum(mine) // len(mine)
    return books, assign()


@pytest.mark.parametrize("size", [256, 20])
def test_codes_equal_brute_force(spark, size):
    rows = messy()
    got = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size, rounds=3).collect()
    kept = whole(rows, 8)
    books, found = lloyd(kept, 4, size, 3)
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] += e
    want = Counter((i, y, "".join(f"{k:02x}" for _, k in f), e, by_label[y], codebooks.digest(np.array(books))) for (i, _, y), f, e in zip(kept, found, errors, strict=True))
    assert Counter(map(tuple, got)) == want and len(got) == 704


def test_codes_of_few_odd_and_no_vectors(spark):
    three = [(i, [0.1 * i, 0.2, -0.3, 0.4, 5e30], None, "", 1, "", 1) for i in range(3)]
    got = codebooks.compress(spark.createDataFrame(three, SCHEMA)).collect()  # five entries: cut into parts of two
    assert sorted(r.code for r in got) == ["00000000", "01000000", "02000000"] and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}
    for none in ([], [(1, None, 1, "", 1, "", 1), (2, [], 1, "", 1, "", 1), (3, [NAN], 1, "", 1, "", 1)]):
        empty = codebooks.compress(spark.createDataFrame(none, SCHEMA))
        assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and not empty.collect()


@pytest.mark.parametrize("spread", [2, 300, 1 << 26])
def test_trees_find_the_first_of_the_nearest(spread):
    """Coarse grids make ties; wide ones leave the range in which doubles are exact."""
    draw = np.random.default_rng(spread)
    for n in (1, 2, 16, 17, 100, 256):
        entries = draw.integers(-spread, spread + 1, (n, 5))
        entries[draw.integers(0, n, n // 3)] = entries[0]
        points = np.vstack([draw.integers(-spread, spread + 1, (200, 5)), entries])
        tree = codebooks.Tree(entries)
        found, distance = tree.nearest(points)
        every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert all(len(m) <= codebooks.LEAF or (entries[m] == entries[m[0]]).all() for _, _, m, axis, _, _, _ in tree.nodes if axis < 0)


def test_whitening_equals_brute_force(spark):
    rows = messy(width=8, n=600)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4), components=6).collect()
    kept = whole(rows, 8)
    x = np.array([np.floor(64 * v).astype(np.int64) + 1_000_000 for _, v, _ in kept])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = c @ axes[:, :6] / np.sqrt(values[:6])
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == 6 * n and {r.n for r in got} == {n}
    deviation = ((n * x - s) ** 2).sum(axis=1).tolist()
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, d) for (i, _, _), d in zip(kept, deviation, strict=True))
    signs = {}
    for (i, _, _), d, w in zip(kept, deviation, want, strict=True):
        for r in by[(i, d)]:
            sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]) or None) if abs(w[r.component - 1]) > 1e-6 else signs.get(r.component, 1)
            assert abs(r.whitened - (sign or 1) * w[r.component - 1]) < 1e-6
            assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    values_of = {k: {r.component: r.whitened for r in v} for k, v in by.items()}  # repeated rows are alike
    w = np.array([[values_of[i, d][k + 1] for k in range(6)] for (i, _, _), d in zip(kept, deviation, strict=True)])
    assert 0 <= got[0].identity_error < 1e-9 and np.abs(w.T @ w / n - np.eye(6)).max() < 1e-6


def test_whitening_of_flat_few_and_no_vectors(spark):
    flat = [(i, [1.0, float(i % 2), 1.0], None, "", 1, "", 1) for i in range(6)] + [(None, [1.0, 0.0, 1.0], None, "", 1, "", 1)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(got) == 21 and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12
    assert abs(next(r.explained for r in got if r.component == 1) - 1) < 1e-12
    alone = whitening.whiten(spark.createDataFrame(flat[:1], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone, key=lambda r: r.component)] == [(k, 1, 0, None, None, 0.0) for k in (1, 2, 3)]
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], 1, "", 1, "", 1), (2, [-1e30, 0.0], 1, "", 1, "", 1)], SCHEMA)).collect()
    assert {r.deviation for r in far} == {None} and {round(abs(r.whitened), 9) for r in far if r.component == 1} == {1.0}
    for none in ([], [(1, None, 1, "", 1, "", 1), (2, [], 1, "", 1, "", 1), (3, [NAN], 1, "", 1, "", 1)]):
        assert not whitening.whiten(spark.createDataFrame(none, SCHEMA)).collect()


def test_rotations_keep_small_eigenvalues():
    """A graded matrix: eigenvalues from 1 to 1e-18, each to ten digits."""
    d = 10
    scale = np.diag(10.0 ** -np.arange(d))
    core = np.eye(d) + 0.1 * np.fromfunction(lambda i, j: np.cos(i * j + 1.0) + np.cos(i * j + 1.0).T, (d, d)) * (1 - np.eye(d))
    core = (core + core.T) / 2
    a = scale @ core @ scale
    values, axes = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all() and np.abs(axes.T @ axes - np.eye(d)).max() < 1e-12
    product = np.prod(values / np.diag(scale) ** 2)
    assert abs(product / np.linalg.det(core) - 1) < 1e-10 and values[-1] > 0
    assert np.abs(axes @ np.diag(values) @ axes.T - a).max() < 1e-12
    for trivial in (np.zeros((3, 3)), np.eye(1), np.ones((4, 4))):
        values, axes = whitening.jacobi(trivial)
        assert np.allclose(axes @ np.diag(values) @ axes.T, trivial)


def test_vectors_of_other_types_and_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, None]), (3, [4]), (4, [5, 6])], "vec_id long, embedding array<int>")
    held = vectors.held(df, "embedding", "vec_id")
    assert vectors.width_of(held) == 2
    n, total = vectors.summed(held, 2, lambda x: x.sum(axis=0))
    assert n == 2 and total.tolist() == [6.0, 8.0]


def test_slices_are_bounded_and_whole(spark):
    import pyarrow as pa

    texts = ["x" * (n * 37 % 5000) for n in range(2000)] + ["y" * 100_000] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), 50_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.nbytes <= 50_000 or p.num_rows == 1 for p in parts) and len(parts) < 400
