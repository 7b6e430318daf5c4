"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from lodestone.llm.common import cut, map_batches, pieces, written
from lodestone.llm.hashing import combine, hashes_of
from lodestone.llm.vectors import summed

#: What is measured of a text, in this order.
STATISTICS = ("words", "word_length", "symbols", "punctuation", "digits", "capitals", "beyond_ascii", "words_a_line", "repeated_lines", "distinct_words", "repeated_windows", "commonest_word", "word_entropy", "doubled_words")
#: Cosines that stand for the kernel.
FEATURES = 200
#: Parts of the labelled rows; each is scored by what the others teach, for the choice of the penalty and for calibration.
FOLDS = 5
#: Ridge penalties tried, per row.
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
#: Standard deviations from the mean beyond which a statistic counts as being there.
FARTHEST = 4.0
#: Raw scores are counted in bins from -0.5 to 1.5 before calibration.
BINS = 2000
#: Characters of texts that are measured at once.
PIECE = 1 << 20
SYMBOLS, PUNCTUATION = b"#*$%&|<>", b".,;:!?"


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def measure(text: bytes, h: np.ndarray) -> list[float]:
    """STATISTICS of a text and the hashes of its lower-cased words."""
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = len(h)
    points = int(c[33:128].sum() + c[:9].sum() + c[14:32].sum() + c[192:].sum())  # without white space; of several bytes the first counts
    letters = int(c[65:91].sum() + c[97:123].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    ordered = np.sort(h)
    times = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))) if n else np.zeros(0)
    windows = np.sort(combine(h, (0, 1, 2)))
    same = windows[1:] == windows[:-1]
    again = int((np.concatenate(([False], same)) | np.concatenate((same, [False]))).sum()) if len(windows) else 0
    p = times / n if n else times
    return [
        float(np.log1p(n)), _share(points, n), _share(int(c[list(SYMBOLS)].sum()), n), _share(int(c[list(PUNCTUATION)].sum()), n), _share(int(c[48:58].sum()), points), _share(int(c[65:91].sum()), letters),
        _share(int(c[192:].sum()), points), float(np.log1p(_share(n, len(lines)))), 1 - _share(len(set(lines)), len(lines)) if lines else 0.0, _share(len(times), n),
        _share(again, len(windows)), _share(int(times.max(initial=0)), n), float(-(p * np.log(p)).sum() / np.log(n)) if n > 1 else 0.0, _share(int((h[1:] == h[:-1]).sum()), n),
    ]


def statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and x, the STATISTICS of the whole text; a null text is an empty one, all of whose statistics are 0."""
    schema = StructType([*(StructField(k, docs.schema[k].dataType) for k in keep), StructField("x", ArrayType(DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("_text").to_pylist()]
            x = np.zeros((len(texts), len(STATISTICS)))
            for i, j in pieces(texts, PIECE):
                for k, h in hashes_of(texts[i:j]):
                    x[i + k] = measure(texts[i + k], h)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(x), pa.list_(pa.float64()))], schema.names)

    return map_batches(docs.select(*keep, F.col(text).cast("string").alias("_text")), task, schema)


class Model(NamedTuple):
    """mean and scale of the statistics, frequencies and phases of the cosines, their weights (the last for the constant), and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2 / FEATURES) * cos(z w + b), whose products approximate a Gaussian kernel of the standardised statistics z; and a constant."""
        z = np.clip((x - self.mean) / self.scale, -FARTHEST, FARTHEST)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.raw, self.calibrated)


def solve(products: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from Z'Z, whose last row and column are those of y; the constant (last but one) goes unpenalised."""
    d = len(products) - 1
    n = products[d - 1, d - 1]
    fine = np.full(d, penalty * max(n, 1.0))
    fine[d - 1] = 1e-9
    return np.linalg.solve(products[:d, :d] + np.diag(fine), products[:d, d])


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising line from raw scores to shares of ones: neighbouring bins are pooled while their shares fall."""
    blocks: list[list[float]] = []  # rows, ones, rows times place
    for a, k, o in zip(at.tolist(), n.tolist(), ones.tolist(), strict=True):
        blocks.append([k, o, k * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(taught: DataFrame, seed: int = 7) -> Model | None:
    """The model that `taught` teaches: x holds the statistics, then the label (0 to 1), then the fold. None without rows.

    All rows teach: moments, normal equations by fold and counts of raw scores by bin are summed task by task, and the driver gets their cells alone."""
    s = len(STATISTICS)

    def moments(x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, :s].sum(axis=0), (x[:, :s] ** 2).sum(axis=0)])

    n, sums = summed(taught, s + 2, moments)
    if not n:
        return None
    mean = sums[0] / n
    scale = np.sqrt(np.maximum(sums[1] / n - mean * mean, 0.0))
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    # the kernel's width is the root of half the mean squared distance of two rows, which is the number of statistics
    frequencies, phases = draw.normal(size=(s, FEATURES)) / np.sqrt(s), draw.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    plain = Model(mean, scale, frequencies, phases, none, none, none)
    places = np.triu_indices(FEATURES + 2)

    def equations(x: np.ndarray) -> np.ndarray:
        z = np.hstack([plain.features(x[:, :s]), x[:, s : s + 1]])
        return np.stack([(z[x[:, s + 1] == f].T @ z[x[:, s + 1] == f])[places] for f in range(FOLDS)])

    _, packed = summed(taught, s + 2, equations)
    folds = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for f in range(FOLDS):
        folds[f][places] = packed[f]
        folds[f] += np.triu(folds[f], 1).T
    whole = folds.sum(axis=0)

    def error(penalty: float) -> float:
        """Squared errors of every fold under the weights of the others, from its sums alone."""
        return sum(float(v @ p @ v) for p in folds for v in [np.append(solve(whole - p, penalty), -1.0)])

    penalty = min(PENALTIES, key=error)
    others = np.stack([solve(whole - p, penalty) for p in folds])

    def counts(x: np.ndarray) -> np.ndarray:
        raw = (plain.features(x[:, :s]) * others[x[:, s + 1].astype(int)]).sum(axis=1)
        at = np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(int)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, x[:, s], BINS)]).astype(float)

    _, binned = summed(taught, s + 2, counts)
    used = np.flatnonzero(binned[0])
    raw, calibrated = isotonic((used + 0.5) * (2 / BINS) - 0.5, binned[0][used], binned[1][used])
    return plain._replace(weights=solve(whole, penalty), raw=raw, calibrated=np.clip(calibrated, 0.0, 1.0))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The model learns from the labels of documents whose crc32(doc_id as text) mod 5 is not 0, and from their statistics alone. A document with several labels
    learns from their mean; null labels and labels without a document teach nothing, labels beyond 0 and 1 count as these. Null ids are neither held out nor labelled;
    rows of one id are scored each by its own text. Without any label all scores are 0.5. An empty table gives no rows; other columns are left out."""
    measured = written(statistics(docs), "statistics")
    crc = _remainder(F.col("doc_id"))
    held_out = F.coalesce(crc % 5 == 0, F.lit(False))
    told = labels.select(F.col("doc_id").alias("_id"), F.least(F.greatest(F.col(label).cast("double"), F.lit(0.0)), F.lit(1.0)).alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.avg("_y").alias("_y"))
    fold = F.floor(crc / 5) % FOLDS
    taught = cut(measured.filter(~held_out).join(told, F.col("doc_id") == F.col("_id")).select(F.concat("x", F.array(F.col("_y"), fold.cast("double"))).alias("x")))
    model = fit(taught, seed)
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))
            s = given.value.score(x) if given.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return map_batches(measured.select("doc_id", held_out.alias("held_out"), "x"), task, schema)
