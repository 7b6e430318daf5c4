"""The quality classifier: statistics, sums and calibration against plain versions, accuracy on documents that it hasn't seen."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import classifier
from lodestone.llm.hashing import hashes_of

SCHEMA = "doc_id long, text string, lang string, x string, score double, quality int"


def plainly(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
    n = len(words)
    chars = [c for c in text if c not in " \t\n\x0b\x0c\r"]
    count = lambda s: sum(text.count(c) for c in s)
    share = lambda a, b: a / b if b else 0.0
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    times, windows = Counter(words), Counter(zip(words, words[1:], words[2:], strict=False))
    total = sum(windows.values())
    entropy = -sum(v / n * math.log(v / n) for v in times.values()) / math.log(n) if n > 1 else 0.0
    return [
        math.log1p(n), share(len(chars), n), share(count("#*$%&|<>"), n), share(count(".,;:!?"), n), share(len(re.findall("[0-9]", text)), len(chars)), share(upper, upper + lower), share(sum(c > "\x7f" for c in chars), len(chars)),
        math.log1p(share(n, len(lines))), 1 - share(len(set(lines)), len(lines)) if lines else 0.0, share(len(times), n), share(sum(v for v in windows.values() if v > 1), total), share(max(times.values(), default=0), n), entropy, share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
    ]


def messy():
    r = random.Random(2)
    prose = " ".join(r.choices("the of and whole part éa ünd 中文 a.b Stop! x#y".split(), k=400))
    return [None, "", " \n\t", "one", "One ONE", "a\nb\na\n\n a", "!!! ### |", prose, prose + "\n" + prose.upper(), "z" * 90_000, "ab " * 30_000, "😀 \x00 \x7f 1234 5"]


def test_statistics_equal_plain_ones(spark):
    texts = messy()
    docs = spark.createDataFrame([(i, t, None, "clash", 0.5, 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.x for r in classifier.statistics(docs).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plainly(t or ""), atol=1e-9), (i, got[i], plainly(t or ""))
    assert len(got[0]) == len(classifier.STATISTICS) and set(got[0]) == {0.0}
    alone = [classifier.measure((t or "").encode(), h) for t, (_, h) in zip(texts, hashes_of([(t or "").encode() for t in texts]), strict=True)]
    assert all(np.allclose(a, got[i]) for i, a in enumerate(alone))


def test_sums_over_tasks_equal_one_regression(spark):
    draw = np.random.default_rng(1)
    s = len(classifier.STATISTICS)
    x, fold = draw.normal(size=(900, s)), draw.integers(0, classifier.FOLDS, 900)
    y = (np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + draw.normal(size=900) * 0.3 > 1).astype(float)
    df = spark.createDataFrame([([*map(float, a), float(b), float(f)],) for a, b, f in zip(x, y, fold, strict=True)], "x array<double>").repartition(7)
    model = classifier.fit(df)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.features(x)
    best = min(classifier.PENALTIES, key=lambda p: sum(((y[fold == f] - z[fold == f] @ ridge(z[fold != f], y[fold != f], p)) ** 2).sum() for f in range(classifier.FOLDS)))
    assert np.allclose(model.weights, ridge(z, y, best), atol=1e-6)
    raw = np.concatenate([z[fold == f] @ ridge(z[fold != f], y[fold != f], best) for f in range(classifier.FOLDS)])
    labels = np.concatenate([y[fold == f] for f in range(classifier.FOLDS)])
    assert (np.diff(model.raw) > 0).all() and (np.diff(model.calibrated) >= 0).all()
    calibrated = np.interp(raw, model.raw, model.calibrated)
    assert abs(calibrated.mean() - labels.mean()) < 0.02 and ((calibrated - labels) ** 2).mean() <= ((np.clip(raw, 0, 1) - labels) ** 2).mean() + 0.005


def ridge(z, y, penalty):
    fine = np.full(z.shape[1], penalty * len(z))
    fine[-1] = 1e-9
    return np.linalg.solve(z.T @ z + np.diag(fine), z.T @ y)


def test_cosines_approximate_the_kernel():
    s = len(classifier.STATISTICS)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, s))
    none = np.zeros(0)
    grams = []
    for seed in range(40):
        d = np.random.default_rng(seed)
        m = classifier.Model(np.zeros(s), np.ones(s), d.normal(size=(s, classifier.FEATURES)) / np.sqrt(s), d.uniform(0, 2 * np.pi, classifier.FEATURES), none, none, none)
        z = m.features(x)[:, :-1]
        grams.append(z @ z.T)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * s))
    assert np.abs(np.mean(grams, axis=0) - kernel).max() < 0.06


def test_pooling_equals_the_best_rising_line():
    draw = random.Random(6)
    for _ in range(200):
        k = draw.randint(1, 8)
        n = np.array([draw.randint(1, 5) for _ in range(k)], dtype=float)
        ones = np.array([draw.randint(0, int(v)) for v in n], dtype=float)
        at, share = classifier.isotonic(np.arange(k, dtype=float), n, ones)
        # the k-th value of a rising line is the greatest of least averages
        want = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(m, k)) for i in range(m + 1)) for m in range(k)]
        assert np.allclose(sorted(set(np.round(want, 12))), share) and (np.diff(at) > 0).all() and (np.diff(share) > 0).all()


def test_odd_labels_and_tables(spark):
    docs = spark.createDataFrame([(i if i % 11 else None, t, None, "clash", 0.5, 1) for i, t in enumerate(messy() * 4)] + [(5, "again", None, "c", 0.1, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.score(docs, none).collect()
    assert len(got) == 49 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, -2), (6, 1), (999, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    got = classifier.score(docs, odd).collect()
    assert len(got) == 49 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    one = classifier.score(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()
    assert all(abs(r.score - 1) < 1e-6 for r in one)
    empty = classifier.score(docs.filter("false"), odd)
    assert empty.columns == ["doc_id", "held_out", "score", "predicted"] and not empty.collect()


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_documents_not_seen(spark):
    """Held-out labels are never learnt from: turning them about changes no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.score(docs, labels)
    scores = {r.doc_id: (r.score, r.predicted, r.held_out) for r in got.collect()}
    assert len(scores) == docs.count()
    judged = [(scores[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in scores and scores[r.doc_id][2]]
    good, bad = sorted(s for (s, _, _), q in judged if q == 1), [s for (s, _, _), q in judged if q == 0]
    above = sum(np.searchsorted(good, s, "left") + (np.searchsorted(good, s, "right") - np.searchsorted(good, s, "left")) / 2 for s in bad)
    assert len(judged) > 700 and 1 - above / len(good) / len(bad) > 0.995
    assert sum(p == q for (_, p, _), q in judged) / len(judged) > 0.99
    assert sum((s - q) ** 2 for (s, _, _), q in judged) / len(judged) < 0.01
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.score(docs, turned).collect()}
    assert all(abs(again[i] - s) < 1e-6 for i, (s, _, _) in scores.items())
