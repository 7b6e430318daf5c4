"""Secret scans: patterns propose, a character convolutional network decides on everything the patterns can't vouch for.

Candidates are the base matches (kinds assign, access, hex), which always stay, and any other run of key-like
characters (kind cnn), which stays if the network's calibrated probability reaches its threshold. A run that holds a
base match and goes on beyond it is a candidate as a whole. The network sees the candidate and the characters around
it; a long one in several windows, of which the likeliest counts.

`fit` trains it on labelled findings: all distinct ones of the table itself (base matches in their surroundings are
secrets, runs that `harmless` knows for words, hosts and names are not), and TRAIN_ROWS that `labelled_findings` makes
from a seed, for kinds that the table doesn't hold. Embedding and convolution are learnt from the latter; the logistic
unit over them from both, by Newton's method, whose gradient and Hessian tasks sum over all of the table's findings.
Those of either label weigh as much together as the made ones. A part of either is kept back: one half calibrates the
probabilities and sets the threshold, the highest that still finds RECALL of the secrets of each kind of source; the
other half reports what that is worth. The weights (some tens of kB) travel with the tasks.

Edge cases: a null text is the empty text, which has no spans; repeated rows are scanned each on its own; an empty
table gives no rows; other columns are ignored (`redact` keeps them all). Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import itertools
import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lodestone.llm.common import cut, map_batches
from lodestone.operators.graph import global_rank

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters
#: Runs of key-like characters with a letter are candidates.
RUN, _LETTER = re.compile("[A-Za-z0-9+/_.=-]{16,}"), re.compile("[A-Za-z]")
#: Parts of runs that no key has: words, numbers of up to eight digits, words with up to four digits at an end.
_PART, _PLAIN = re.compile("[A-Za-z0-9]+"), re.compile("[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8}|[0-9]{1,4}[a-z]+|(?:[A-Z][a-z]+){2,}[0-9]{0,4}")
_MUTE = re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6}")
REPLACEMENT = "[SECRET]"

TRAIN_ROWS, CALIBRATION_ROWS, EPOCHS, RECALL, SEED = 3000, 1500, 5, 0.98, 7
#: Of the table's findings, parts of five that train; what one of a small table weighs in training at most; and steps of Newton's method at most.
TRAIN_PARTS, REPEATS, NEWTON = 3, 20, 30
BEFORE, WITHIN, AFTER = 24, 56, 8
WIDTH = BEFORE + WITHIN + AFTER
EMBED, TAPS, FILTERS = 8, 5, 24
_CODES = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(string.printable):
    _CODES[ord(_c)] = _i + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def other_candidates(text: str, base: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs that no base span covers."""
    found, k = [], 0
    ends = sorted((s, e) for s, e, _ in base)
    for m in RUN.finditer(text):
        start, stop = m.span()
        if not _LETTER.search(text, start, stop):
            continue
        while k < len(ends) and ends[k][1] <= start:
            k += 1
        if not any(s <= start and e >= stop for s, e in itertools.takewhile(lambda x: x[0] <= start, ends[k:])):
            found.append((start, stop, "cnn"))
    return found


def harmless(run: str) -> bool:
    """Whether a run is made of words and small numbers alone. Letters count as a word only if they can be spoken: long runs of consonants may be a key."""
    return all(_PLAIN.fullmatch(p) and not _MUTE.search(p) for p in _PART.findall(run))


def window(text: str, start: int, end: int) -> str:
    r"""BEFORE characters, WITHIN of the candidate from its start and AFTER characters; \x00 fills what isn't there."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + WITHIN)].ljust(WITHIN, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows that hold all of the candidate between them."""
    last = max(start, end - WITHIN)
    return [window(text, at, end) for at in (*range(start, last, WITHIN), last)]


def encode(windows: Sequence[str]) -> np.ndarray:
    """One row of codes per window: 0 fills, 1 is any character outside ASCII."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), dtype=np.uint32).reshape(len(windows), WIDTH)
    return np.where(raw == 0, 0, np.where(raw < 128, _CODES[np.minimum(raw, 255)], 1))


@dataclass
class Network:
    """embedding, convolution, maximum over the context, over the candidate and mean over the candidate, then a logistic unit."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    report: dict = field(default_factory=dict)

    def features(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.embedding[codes]
        columns = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - TAPS + 1, TAPS * EMBED)
        z = np.maximum(columns @ self.kernel + self.bias, 0)
        around, inner = np.concatenate((z[:, :BEFORE], z[:, BEFORE + WITHIN - TAPS :]), axis=1), z[:, BEFORE : BEFORE + WITHIN - TAPS]
        pooled = np.concatenate((around.max(1), inner.max(1), inner.mean(1)), axis=1)
        return pooled, z, columns

    def logits(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.empty(0)
        return np.concatenate([self.features(codes[i : i + 2048])[0] @ self.weights + self.intercept for i in range(0, len(codes), 2048)])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -30, 30)))


_WORDS = "the and report value build commit version page order number service account region client server request update batch user data image model config path name list item field test run key id ref from with for this that note see file line".split()
_B64, _ALNUM, _HEX, _UP = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits


def labelled_findings(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Windows and labels (1: a secret), half of each, of many kinds; equal seeds give equal sets."""
    r = random.Random(seed)
    run = lambda chars, a, b=None: "".join(r.choices(chars, k=r.randint(a, b or a)))
    word = lambda: r.choice(_WORDS) if r.random() < 0.5 else run("aeiounrstlhdm", 2, 9)
    prose = lambda k: " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str, str]:
        value = r.choice((
            lambda: run(_ALNUM, 20, 44), lambda: run(_B64, 24, 60) + r.choice(("", "=", "==")), lambda: "ghp_" + run(_ALNUM, 36), lambda: "xoxb-" + run(string.digits, 11) + "-" + run(_ALNUM, 24),
            lambda: "sk_live_" + run(_ALNUM, 24), lambda: "eyJ" + run(_ALNUM, 20, 40) + "." + run(_ALNUM + "_-", 30, 60) + "." + run(_ALNUM + "_-", 20, 43),
            lambda: "AIza" + run(_ALNUM + "_-", 35), lambda: run(_HEX, 32, 64), lambda: run(_HEX, 16, 31), lambda: run(string.digits, 16, 24), lambda: run(_UP, 20, 32), lambda: "glpat-" + run(_ALNUM + "_-", 20), lambda: "SG." + run(_ALNUM, 22) + "." + run(_ALNUM, 43),
        ))()
        lead = r.choice(("key: ", "key=", "Authorization: Bearer ", "secret ", "token is ", "export API=", "credentials = \"", "pwd: ", "auth ", "use ", "")) if r.random() < 0.7 else ""
        return prose(4) + " " + lead, value, r.choice(("\" ", " ", "\n", ", ", ". ")) + prose(2)

    def plain() -> tuple[str, str, str]:
        w = lambda: word().replace(" ", "")
        host = lambda: r.choice((w(), w() + run(string.digits, 1, 2))) + "." + r.choice(("example", w())) + "." + r.choice(("com", "org", "net", "de"))
        value = r.choice((
            lambda: host() + "." + w() + run(string.digits, 1, 3), lambda: "/".join((w(), w(), w() + run(string.digits, 1, 4), w())) + ".html", lambda: "".join(w().capitalize() for _ in range(4)) + run(string.digits, 1, 2),
            lambda: "_".join((w(), w(), w(), run(string.digits, 1, 4))), lambda: w() + "-" + w() + "-" + w() + "-" + run(string.digits, 1, 6), lambda: w() + w() + w() + "." + run(string.digits, 1, 4),
            lambda: "2" + run(string.digits, 3) + "-" + run(string.digits, 2) + "-" + run(string.digits, 2) + "T" + run(string.digits, 6) + "Z", lambda: w() + "-" + ".".join(run(string.digits, 1, 2) for _ in range(3)) + "-" + w() + ".tar.gz",
            lambda: "=" * r.randint(8, 20) + w() + run(string.digits, 1) + "=" * 8, lambda: w() + w() + w() + w() + w() + run(string.digits, 1, 2), lambda: "mail" + run(string.digits, 1) + "." + w() + w() + ".com", lambda: run(string.digits, 4) + "-" + w() + "-" + w() + w(),
            lambda: ".".join(w() for _ in range(4)) + "." + run(string.digits, 1, 2), lambda: (w() + w() + w()).upper() + run(string.digits, 1, 3) + w().upper(),
        ))()
        lead = r.choice(("see ", "file ", "at ", "https://", "key: ", "name=", "", "")) if r.random() < 0.6 else r.choice((".", "@", "", "- "))
        return prose(4) + " " + lead, value, r.choice((" ", "\n", ", ", "@", ". ")) + prose(2)

    made, labels = [], np.zeros(n)
    for i in range(n):
        labels[i] = i % 2
        before, value, after = secret() if i % 2 else plain()
        while len(value) < 16:
            value += word() + run(string.digits, 1) if not i % 2 else run(_ALNUM, 4)
        made.append(window(before + value + after, len(before), len(before) + len(value)))
    return made, labels


def table_findings(docs: DataFrame) -> DataFrame:
    """window, label, part (0 to 4): all distinct findings of a table of either label, base matches and harmless runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, int]] = set()
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                found.update((window(t, s, e), 1) for s, e, _ in base)
                found.update((window(t, s, e), 0) for s, e, _ in other_candidates(t or "", base) if harmless(t[s:e]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["window", "label"])

    every = map_batches(docs.select("text"), run, "window string, label long").distinct()
    return every.withColumn("part", F.crc32(F.col("window").cast("binary")) % 5)


def _pooled(findings: DataFrame, net: Network) -> DataFrame:
    """label, part, x: the findings' features under the network's convolution, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                x = net.features(encode(b.column("window").to_pylist()))[0].astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("label"), b.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["label", "part", "x"])

    return cut(map_batches(findings, run, "label long, part long, x array<float>"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of weighted rows in one line; the last of x is 1."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = weight @ (np.logaddexp(0, z) - y * z)
    return np.concatenate(([loss], x.T @ (weight * (p - y)), ((x.T * (weight * p * (1 - p))) @ x).ravel()))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1))))


def _optimum(rows: DataFrame, made: np.ndarray, made_labels: np.ndarray, weights: Sequence[float], start: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The least of the logistic loss over all rows (label, x), weighted by label, those of `made`, and half the squared distance from `start`; with `onto`, over x's product with it alone. A step of Newton's is a job, in which every task sums its rows' gradient and Hessian; a step that makes the loss greater is halved."""
    size = len(start)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for b in batches:
                x, y = _with_one(b.column("x").flatten().to_numpy().reshape(len(b), -1).astype(np.float64)), b.column("label").to_numpy()
                total += _logistic(x if onto is None else _with_one((x @ onto)[:, None]), y, np.where(y == 1, weights[1], weights[0]), w)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "x"])

        total = _logistic(made, made_labels, np.ones(len(made)), w)
        for r in map_batches(rows.select("label", "x"), run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # size**2 numbers
            total[r.i] += r.x
        total[0] += (w - start) @ (w - start) / 2
        total[1 : 1 + size] += w - start
        total[1 + size :] += np.eye(size).ravel()
        return total

    w, now = start, sums(start)
    for _ in range(NEWTON):
        step = np.linalg.solve(now[1 + size :].reshape(size, size), now[1 : 1 + size])
        gain = step @ now[1 : 1 + size]
        if gain <= 1e-6 * (1 + now[0]):
            break
        ahead = sums(w - step)
        while ahead[0] > now[0] and np.abs(step).max() > 1e-9:
            step = step / 2
            ahead = sums(w - step)
        w, now = w - step, ahead
    return w


def _scores(rows: DataFrame, net: Network) -> DataFrame:
    """label, part, p: the network's probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column("x").flatten().to_numpy().reshape(len(b), -1).astype(np.float64) @ net.weights + net.intercept
            p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("part"), pa.array(p)], ["label", "part", "p"])

    return map_batches(rows, run, "label long, part long, p double")


def _table_recall(scores: DataFrame, n: int) -> float:
    """_at_recall of n scores (p) of a table, less what rounding of stored features may take."""
    k = int((1 - RECALL) * n)
    return global_rank(scores.select("p"), ["p"]).filter(F.col("rank") == k).first().p * (1 - 1e-5) if n else 1.0


def fit(docs: DataFrame) -> Network:
    """The network for a table, and in its report the recall and the share of harmless runs found on findings that neither trained nor calibrated it."""
    none = np.empty((0, WIDTH), dtype=np.int64)
    net = train(none, np.empty(0), none, np.empty(0))
    rows = _pooled(table_findings(docs), net)
    counts = {(r.label, r.part): r["count"] for r in rows.groupBy("label", "part").count().collect()}
    if not counts:
        net.report = {"secrets": 0, "recall": None, "harmless": 0, "false": None}
        return net
    amount = lambda y, parts: sum(counts.get((y, k), 0) for k in parts)
    weights = lambda parts, made: [min(float(REPEATS), made / 2 / max(1, amount(y, parts))) for y in (0, 1)]
    learn, held = range(TRAIN_PARTS), (TRAIN_PARTS,)
    texts, labels = labelled_findings(TRAIN_ROWS, SEED)
    made = np.concatenate([net.features(c)[0] for c in np.array_split(encode(texts), 4)])
    head = _optimum(rows.filter(F.col("part") < TRAIN_PARTS), _with_one(made), labels, weights(learn, TRAIN_ROWS), np.append(net.weights, net.intercept))
    net.weights, net.intercept = head[:-1], float(head[-1])
    texts, labels = labelled_findings(CALIBRATION_ROWS, SEED + 1)
    codes = encode(texts)
    net.scale, net.shift = _optimum(rows.filter(F.col("part") == TRAIN_PARTS), _with_one(net.logits(codes)[:, None]), labels, weights(held, CALIBRATION_ROWS), np.array([1.0, 0.0]), head).tolist()
    scores = cut(_scores(rows, net))
    secret = scores.filter("label = 1")
    # however few a table's secrets are, RECALL of all must be found, those that trained included
    net.threshold = min(_at_recall(net.probabilities(codes)[labels == 1], RECALL), _table_recall(secret.filter(F.col("part") == TRAIN_PARTS), amount(1, held)), _table_recall(secret, amount(1, range(5))))
    found = {r.label: r.found for r in scores.filter(F.col("part") > TRAIN_PARTS).groupBy("label").agg(F.avg((F.col("p") >= net.threshold).cast("double")).alias("found")).collect()}
    rest = range(TRAIN_PARTS + 1, 5)
    net.report = {"secrets": amount(1, rest), "recall": found.get(1), "harmless": amount(0, rest), "false": found.get(0)}
    return net


def train(own: np.ndarray, own_labels: np.ndarray, held: np.ndarray, held_labels: np.ndarray, generated: int = TRAIN_ROWS, epochs: int = EPOCHS, recall: float = RECALL, seed: int = SEED) -> Network:
    """Adam on the logistic loss over generated findings and a table's own, then Platt's scaling and the threshold on findings kept back."""
    rng = np.random.default_rng(seed)
    texts, labels = labelled_findings(generated, seed)
    # a small table's findings weigh as much as a third of the generated ones, of either label
    few = [np.flatnonzero(own_labels == y) for y in (0, 1)]
    again = np.concatenate([np.repeat(at, min(REPEATS, max(1, generated // 3 // max(1, len(at))))) for at in few])
    codes, labels = np.concatenate((encode(texts), own[again])), np.concatenate((labels, own_labels[again]))
    rows = len(codes)
    net = Network(rng.normal(0, 0.3, (len(string.printable) + 2, EMBED)), rng.normal(0, (2 / (TAPS * EMBED)) ** 0.5, (TAPS * EMBED, FILTERS)), np.zeros(FILTERS), np.zeros(3 * FILTERS), 0.0)
    params = [net.embedding, net.kernel, net.bias, net.weights]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    inner = slice(BEFORE, BEFORE + WITHIN - TAPS)
    outer = np.r_[0:BEFORE, BEFORE + WITHIN - TAPS : WIDTH - TAPS + 1]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(rows), rows // 128):
            c, y = codes[at], labels[at]
            pooled, z, columns = net.features(c)
            error = (1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.intercept, -30, 30))) - y) / len(at)
            back = error[:, None] * net.weights
            grad = np.zeros_like(z)
            rows_at, filters = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
            grad[rows_at, outer[z[:, outer].argmax(1)], filters] += back[:, :FILTERS]
            grad[rows_at, inner.start + z[:, inner].argmax(1), filters] += back[:, FILTERS : 2 * FILTERS]
            grad[:, inner] += back[:, None, 2 * FILTERS :] / (inner.stop - inner.start)
            grad *= z > 0
            flat = grad.reshape(-1, FILTERS)
            d_columns = (flat @ net.kernel.T).reshape(len(at), -1, TAPS, EMBED)
            d_x = np.zeros((len(at), WIDTH, EMBED))
            for k in range(TAPS):
                d_x[:, k : k + d_columns.shape[1]] += d_columns[:, :, k]
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, c.ravel(), d_x.reshape(-1, EMBED))
            grads = [d_embedding, columns.reshape(-1, TAPS * EMBED).T @ flat, flat.sum(0), pooled.T @ error]
            step += 1
            net.intercept -= 0.5 * float(error.sum())
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return calibrate(net, held, held_labels, recall, seed + 1)


def calibrate(net: Network, held: np.ndarray, held_labels: np.ndarray, recall: float, seed: int) -> Network:
    texts, labels = labelled_findings(CALIBRATION_ROWS, seed)
    made = encode(texts)
    x, y = net.logits(np.concatenate((made, held))), np.concatenate((labels, held_labels))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(net.scale * x + net.shift, -30, 30)))
        net.scale -= 0.05 * float(((p - y) * x).mean())
        net.shift -= 0.05 * float((p - y).mean())
    net.threshold = min(_at_recall(net.probabilities(c)[z == 1], recall) for c, z in ((made, labels), (held, held_labels)))
    return net


def _at_recall(scores: np.ndarray, recall: float) -> float:
    """The greatest threshold that this share of the scores reaches; 1 without scores."""
    return float(np.sort(scores)[int((1 - recall) * len(scores))]) if len(scores) else 1.0


def scan_texts(texts: Sequence[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, probability) of the spans of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    other = [other_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    places = [(i, s, e, k) for i in range(len(texts)) for s, e, k in (*base[i], *other[i])]
    scores: list[float] = []
    for at in range(0, len(places), 1024):
        seen = [windows(texts[i], s, e) for i, s, e, _ in places[at : at + 1024]]
        firsts = np.cumsum([0, *map(len, seen)])[:-1]
        scores += np.maximum.reduceat(net.probabilities(encode([w for x in seen for w in x])), firsts).tolist()
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, s, e, k), p in zip(places, scores, strict=True):
        if k != "cnn" or p >= net.threshold:
            out[i].append((s, e, k, p))
    for spans in out:
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def redact_text(text: str, spans: Sequence[tuple]) -> str:
    out, at = [], 0
    for s, e, *_ in spans:
        if s >= at:
            out += [text[at:s], REPLACEMENT]
        at = max(at, e)
    return "".join(out) + text[at:]


_SPANS = "array<struct<start:int,end:int,kind:string,probability:double>>"


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and spans: start and end (code points, end exclusive), kind and the network's probability."""
    net = net or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))
        for b in batches:
            spans = scan_texts([t or "" for t in b.column("text").to_pylist()], net)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[dict(zip(("start", "end", "kind", "probability"), x, strict=True)) for x in s] for s in spans], kind)], names=["doc_id", "spans"])

    schema = StructType([docs.schema["doc_id"], StructField("spans", ArrayType(StructType.fromDDL("start int, end int, kind string, probability double")))])
    return map_batches(docs.select("doc_id", "text"), run, schema)


def digests(spans: DataFrame) -> DataFrame:
    """The counts and digests of `scan`'s spans."""
    base = F.filter("spans", lambda x: x.kind != "cnn")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with REPLACEMENT for every span of its texts (overlapping spans as one), and n_chars, if there, counted anew; null texts stay null."""
    net = net or fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            done = [None if t is None else redact_text(t, s) for t, s in zip(texts, scan_texts([t or "" for t in texts], net), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    done = map_batches(docs, run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return done
