"""Language-model scores by a hierarchical Pitman-Yor model of word triples.

The two words before a token are its context. Every context (u1, u2) has a restaurant whose customers are the words that
follow it in the training documents; its tables are customers of the restaurant of (u2), which all contexts that end in
u2 share as their parent; the tables of those are customers of the one root, whose parent is uniform over the known
words and one unknown. With c customers at t tables of a dish, and C and T of all dishes of a restaurant:

    p(w | u1 u2) = (c - d T_w) / (theta + C) + (theta + d T) / (theta + C) * p(w | u2), and so on up to the root.

Seating is sampled by Gibbs: a sweep seats all customers of every dish anew, given the tables of the other dishes and
the parent's probabilities, and then draws each level's discount and strength from their likelihood on a grid. Scores
are of the predictive probabilities averaged over SAMPLES seatings.

Work is dealt out by numpy blobs, so that what is shuffled is each chunk's distinct triples, not its tokens:

1. `chunks`: some million tokens at a time become places in the chunk's list of distinct words; written as Parquet.
2. `vocabulary`: words get numbers, small ones for frequent words, which squeeze well, and their counts.
3. `requests`: each chunk sends its distinct triples, with their training counts, to the part of the middle word u2. A
   part therefore has the restaurants of its words and of all contexts that end in them whole. The contexts of a word with
   more tokens than PER_PART are dealt out by classes of the word before it. They still share the one restaurant of that
   word, which is seated dish by dish where the root's are: parts send their customers of its dishes there and are told
   c - d t. The model is the same whatever the size; only where a restaurant is seated depends on it.
4. A part seats its customers, a job per sweep. Between sweeps, `root` sums the customers of the root exactly over all
   parts, seats them and tells the parts. A part's likelihoods for the grid are summed by Spark.
5. `replies`: a part computes the averaged probability of each triple that a chunk has asked for; `score_chunks` puts them
   together and sums over its documents.

A chunk sends a part one message, if it has anything for it: at most one per distinct triple, however many parts there are.

Edge cases: a null text is the empty text, one end token; without training documents N and V are 0 and every word has
probability 1 in the base and the model, the uniform distribution over the unknown word alone; repeated rows are scored
(and learnt from) each; a null doc_id counts as the text 'null'; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint_dir, map_batches
from lodestone.llm.hashing import SPACED, hashes_of, mix

BURN_IN, SAMPLES, SHARES, SEED = 3, 3, 2, 11
#: Tokens of a chunk (a longer document has a chunk of its own), and tokens per part for triples; words have a quarter of the parts.
CHUNK, PER_PART, PARTS_TO_WORDS = 2_000_000, 1_000_000, 4
#: Dishes of up to so many customers draw their tables from the exact distribution; larger ones from its saddle-point form.
EXACT = 256
#: Dishes of up to so many customers weigh their tables without logarithms.
PLAIN = 8
#: The grid from which each level's discount and strength are drawn.
DISCOUNTS = tuple(round(0.1 * k, 2) for k in range(1, 10)) + (0.95,)
STRENGTHS = (0.1, 1.0, 10.0, 100.0)
#: Where sampling begins: (discount, strength) of the root, of contexts of one word and of two.
START = ((0.8, 10.0), (0.8, 1.0), (0.8, 1.0))
#: How hard messages are squeezed: dishes, which every sweep shuffles, and the others (triples are sent as differences, which leaves little to squeeze).
HARD, QUICK = 6, 1
END, BEGIN = np.uint64(0xE0D), 0
_CHUNKS = "chunk long, n_docs long, n_tokens long, body binary"
_MESSAGE = "chunk long, part int, kind int, body binary"
_SUMS = "k int, x double"
_CLASS_BITS = 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray, level: int = QUICK) -> bytes:
    """Arrays of 1-, 4- or 8-byte items, byte by byte transposed, which squeezes well."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in map(np.ascontiguousarray, arrays):
        parts += [np.array([a.itemsize, len(a)], "<i8").tobytes(), *(np.ascontiguousarray(a.view(np.uint8)[k :: a.itemsize]).data for k in range(a.itemsize if len(a) else 0))]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 8, []
    for kind in kinds:
        size, n = np.frombuffer(raw, "<i8", 2, at)
        at += 16
        cells, planes = np.empty((n, size), np.uint8), np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        for k in range(size):
            cells[:, k] = planes[k]
        out.append(cells.view(kind).ravel() if n else np.empty(0, kind))
        at += int(size * n)
    return out


def _shortened(x: np.ndarray, bits: int) -> np.ndarray:
    """x as 32-bit floats, rounded to so many bits of mantissa, as whole numbers; the bits left out squeeze to nothing."""
    rest = 23 - bits
    return (x.astype("<f4").view("<u4") + np.uint32(1 << (rest - 1))) & np.uint32(0xFFFFFFFF << rest & 0xFFFFFFFF)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items in order, and where each item stands among them, as np.unique has it: item and index are sorted as one number, in a fraction of argsort's time."""
    n = len(x)
    x, bits = x.astype(np.uint64), np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    fits = not n or int(x.max()) >> (64 - n.bit_length()) == 0
    both = np.sort((x << bits if fits else x & ~low) | np.arange(n, dtype=np.uint64))
    at = (both & low).astype(np.int64)
    ordered = both >> bits if fits else x[at]
    if not fits and (ordered[1:] < ordered[:-1]).any():  # items that differ in their last bits alone
        return np.unique(x, return_inverse=True)
    new = np.append(True, ordered[1:] != ordered[:-1])[:n]
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(new) - 1
    return ordered[new], place


def _steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2**32; where first is true, items themselves."""
    x = x.astype("<u4")
    return np.where(first, x, np.diff(x, prepend=np.uint32(0)))


def _climbed(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The items back from `_steps`."""
    x = np.cumsum(steps.astype(np.uint64))
    starts = np.flatnonzero(first)
    before = x[starts] - steps[starts]
    return (x - np.repeat(before, np.diff(np.append(starts, len(x))))).astype("<u4")


def _begins(lengths: np.ndarray) -> np.ndarray:
    """Whether an item is the first of its run, for runs of these lengths, none of them empty."""
    first = np.zeros(int(lengths.sum()), bool)
    first[np.cumsum(lengths.astype(np.int64)) - lengths] = True
    return first


def pack_triples(u2: np.ndarray, u1: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    """Triples whose contexts stand together, and their counts: middle words, the words before each of them and the words after each context, all as differences, which are small where they rise."""
    new2 = np.append(True, u2[1:] != u2[:-1])[: len(u2)]
    new = new2 | np.append(True, u1[1:] != u1[:-1])[: len(u1)]
    run = lambda x: np.diff(np.append(np.flatnonzero(x), len(x))).astype("<u4")
    return _pack(_steps(u2[new2], np.arange(new2.sum()) == 0), run(new2[new]), _steps(u1[new], new2[new]), run(new), _steps(w, new), counts.astype("<u4"))


def unpack_triples(body: bytes) -> tuple[np.ndarray, ...]:
    """u2, u1 and number of triples of every context; w and count of every triple."""
    d2, contexts, d1, times, dw, counts = _unpack(body, *["<u4"] * 6)
    u2 = np.repeat(_climbed(d2, np.arange(len(d2)) == 0), contexts)
    return u2, _climbed(d1, _begins(contexts)), times, _climbed(dw, _begins(times)), counts


def _order(to: np.ndarray, parts: int) -> np.ndarray:
    """Order of rows by their part; small numbers are sorted by digits."""
    return np.argsort(to.astype(np.uint16) if parts <= 1 << 16 else to, kind="stable")


def _tasks(df: DataFrame, keys: int) -> int:
    return max(keys, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "part", "kind", "body"])


def _some(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield _messages(rows)


def _places(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each item stands among others in order; -1: nowhere."""
    if not len(among):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by part, and bounds of parts."""
    to = (mix(keys.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = _order(to, parts)
    return order, np.searchsorted(to[order], np.arange(parts + 1))


def _grouped(batches: Iterator[pa.RecordBatch], by: str, columns: Sequence[str]) -> Iterator[tuple[int, list[tuple]]]:
    """The key, and the columns of its rows."""
    key, rows = None, []
    for b in batches:
        for k, *cells in zip(*(b.column(x).to_pylist() for x in (by, *columns)), strict=True):
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(tuple(cells))
    if rows:
        yield key, rows


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """part, and chunk, kind and body of its rows."""
    return _grouped(batches, "part", ("chunk", "kind", "body"))


def _by_part(messages: DataFrame, parts: int) -> DataFrame:
    return messages.select("chunk", "part", "kind", "body").repartition(_tasks(messages, parts), "part").sortWithinPartitions("part", "kind", "chunk")


# 1. Chunks


def chunks(docs: DataFrame) -> DataFrame:
    """The documents' tokens, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, found, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal number
            number += 1
            flat = np.concatenate(found)
            words, places = _ranked(flat)
            order = np.argsort(-np.bincount(places), kind="stable")  # frequent words get small numbers, and of equal ones hashes rise: both squeeze better
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            known = np.array([i is not None for i in ids], np.uint8)
            body = _pack(np.array([i or 0 for i in ids], "<i8"), known, np.array([len(h) for h in found], "<u4"), np.array([held_out(i) for i in ids], np.uint8), rank[places].astype("<u4"), words[order])
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((number, pa.int64()), (len(ids), pa.int64()), (len(flat), pa.int64()), (body, pa.binary()))], names=["chunk", "n_docs", "n_tokens", "body"])

        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            names = b.column("doc_id").to_pylist()
            for i, h in hashes_of([(t or "").encode() for t in b.column("text").to_pylist()], SPACED):
                if found and size + len(h) > CHUNK:
                    yield row()
                    ids, found, size = [], [], 0
                ids.append(names[i])
                found.append(np.append(h, END))
                size += len(h) + 1
        if found:
            yield row()

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _CHUNKS)


@dataclass
class Deal:
    """How triples are dealt to parts: hot middle words (sorted numbers) by so many classes of the word before."""

    parts: int
    hot: np.ndarray
    classes: np.ndarray

    def keys(self, u2: np.ndarray, u1: np.ndarray) -> np.ndarray:
        """What each context is dealt out by: its middle word and, of hot ones, the class of the first word."""
        key = u2.astype(np.uint64) << np.uint64(_CLASS_BITS)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u2), len(self.hot) - 1)
            is_hot = self.hot[at] == u2
            key[is_hot] += mix(u1[is_hot].astype(np.uint64) + np.uint64(1)) % self.classes[at[is_hot]].astype(np.uint64)
        return key

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys + np.uint64(1)) % np.uint64(self.parts)).astype(np.int64)


class Chunk:
    """A chunk's tokens and its distinct triples, in the order in which they are dealt to parts."""

    def __init__(self, body: bytes, numbered: bool = False) -> None:
        """body: as `chunks` packs it, with hashes of words, or as `numbered`, with their numbers and training counts."""
        doc_ids, known, lengths, held, tokens, *words = _unpack(body, "<i8", "u1", "<u4", "u1", "<u4", *(("<u4", "<u8") if numbered else ("<u8",)))
        self.doc_ids, self.known_ids, self.lengths, self.held = doc_ids, known.astype(bool), lengths.astype(np.int64), held.astype(bool)
        self.tokens, self.words = tokens.astype(np.int64), np.cumsum(words[0], dtype=np.int64) if numbered else words[0]
        self.known_counts = words[1].astype(np.int64) if numbered else None
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)

    def numbered(self, numbers: np.ndarray, counts: np.ndarray) -> bytes:
        """Gives words their numbers, in whose order they stand from now on, and packs the chunk."""
        order = np.argsort(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.tokens, self.words, self.known_counts = rank[self.tokens], numbers[order], counts[order]
        return _pack(self.doc_ids, self.known_ids.astype("u1"), self.lengths.astype("<u4"), self.held.astype("u1"), self.tokens.astype("<u4"), np.diff(self.words, prepend=0).astype("<u4"), self.known_counts.astype("<u8"))

    def triples(self, numbers: np.ndarray, deal: Deal) -> None:
        """Sets u1, u2 and w (numbers) of the distinct triples, bounds of parts, training counts, and each token's triple."""
        n, bits = len(self.tokens), (len(self.words) + 1).bit_length()
        u2, u1 = np.zeros(n, np.int64), np.zeros(n, np.int64)  # places from 1; 0 is the beginning
        u2[1:] = self.tokens[:-1] + 1
        u2[self.starts] = 0
        u1[1:] = u2[:-1]
        u1[self.starts] = 0
        split = lambda x: ((x >> np.uint64(bits)).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64))
        contexts, of = _ranked(u2 << bits | u1)
        keys, place = _ranked(of << bits | self.tokens)
        of, w = split(keys)
        del keys
        all_numbers = np.append(np.uint32(BEGIN), numbers.astype(np.uint32))
        u2, u1 = (all_numbers[x] for x in split(contexts))
        part = deal.part(deal.keys(u2, u1))[of]
        u2, u1 = u2[of], u1[of]
        order = _order(part, deal.parts)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.u1, self.u2, self.w = u1[order], u2[order], numbers[w[order]].astype(np.uint32)
        self.place, self.bounds = rank[place], np.searchsorted(part[order], np.arange(deal.parts + 1))
        self.counts = np.bincount(self.place[self.train], minlength=len(order))


# 2. Words


def vocabulary(stored: DataFrame, parts: int) -> DataFrame:
    """kind 3: to chunks, the numbers of their words and their training counts. kind 5 (chunk null): a part's N and V, then the numbers and counts of words with more than PER_PART tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in _chunks_of(batches):
            order, bounds = _dealt(c.words, parts)
            train, every = np.bincount(c.tokens[c.train], minlength=len(c.words)), np.bincount(c.tokens, minlength=len(c.words))
            cut = [(p, order[bounds[p] : bounds[p + 1]]) for p in np.flatnonzero(np.diff(bounds)).tolist()]
            yield _messages([(number, p, 3, _pack(c.words[x], train[x].astype("<u4"), every[x].astype("<u4"))) for p, x in cut])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts_of(batches):
            asked = [(chunk, *_unpack(body, "<u8", "<u4", "<u4")) for chunk, _, body in rows]
            words, where = _ranked(np.concatenate([x[1] for x in asked]))
            train, every = (np.bincount(where, weights=np.concatenate([x[k] for x in asked])).astype(np.int64) for k in (2, 3))
            numbers = np.empty(len(words), np.int64)
            numbers[np.argsort(-every, kind="stable")] = 1 + np.arange(len(words)) * parts + part
            if numbers.max() >= 2**32:
                raise ValueError("more than 2**32 distinct words")
            at = 0
            for chunk, w, *_ in asked:
                place = where[at : at + len(w)]
                yield _messages([(chunk, part, 3, _pack(numbers[place].astype("<u4"), train[place].astype("<u8")))])
                at += len(w)
            hot = every > PER_PART
            yield _messages([(None, part, 5, _pack(np.array([train.sum(), (train > 0).sum()], "<i8"), numbers[hot].astype("<i8"), every[hot].astype("<i8")))])

    return map_batches(_by_part(map_batches(stored.select("chunk", "body"), ask, _MESSAGE), parts), answer, _MESSAGE)


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for b in batches:
        for number, body in zip(b.column("chunk").to_pylist(), b.column("body"), strict=True):
            yield number, Chunk(body.as_py())


def counts_and_hot(words: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, V, and the words with more than PER_PART tokens (of which there are fewer than parts) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body").to_pylist():
                sums, numbers, counts = _unpack(body, "<i8", "<i8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], numbers), pa.int64()), pa.array(np.append(sums, counts), pa.int64())], names=["k", "x"])

    got = {r.k: r.x for r in map_batches(words.filter("kind = 5").select("body"), run, "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    return got.pop(-1, 0), got.pop(-2, 0), got


def _by_chunk(chunks_of: DataFrame, others: DataFrame) -> DataFrame:
    """Chunks (kind 0) and the messages to them, chunk by chunk."""
    whole = chunks_of.select("chunk", F.lit(0).alias("part"), F.lit(0).alias("kind"), "body")
    both = whole.unionByName(others.filter("chunk IS NOT NULL").select(whole.columns))
    return both.repartition(_tasks(both, 1), "chunk").sortWithinPartitions("chunk", "kind", "part")


def requests(stored: DataFrame, words: DataFrame, deal: Deal, word_parts: int) -> DataFrame:
    """kind 0: to parts, a chunk's distinct triples and their training counts; kind 10: the chunk with numbers for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "chunk", ("part", "kind", "body")):
            c = Chunk(next(body for _, kind, body in rows if kind == 0))
            order, bounds = _dealt(c.words, word_parts)
            numbers, counts = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.int64)
            for part, kind, body in rows:
                if kind == 3:
                    x = order[bounds[part] : bounds[part + 1]]
                    numbers[x], counts[x] = _unpack(body, "<u4", "<u8")
            yield _messages([(number, 0, 10, c.numbered(numbers, counts))])
            c.triples(c.words, deal)
            out = []
            for p in np.flatnonzero(np.diff(c.bounds)).tolist():
                x = slice(c.bounds[p], c.bounds[p + 1])
                out.append((number, p, 0, pack_triples(c.u2[x], c.u1[x], c.w[x], c.counts[x])))
                if len(out) >= 64:
                    yield _messages(out)
                    out = []
            if out:
                yield _messages(out)

    return map_batches(_by_chunk(stored, words.filter("kind = 3")), run, _MESSAGE)


# 3. Seating


def _log_gamma(z: np.ndarray) -> np.ndarray:
    out = np.array(z, np.float64)
    k = np.flatnonzero(out < 8)
    small, low = out[k], np.ones(len(k))
    for _ in range(8):  # up to where the series is exact enough
        low = np.where(small < 8, low * small, low)
        small = np.where(small < 8, small + 1, small)
    out[k] = small
    over = 1 / out
    out = (out - 0.5) * np.log(out) - out + 0.5 * np.log(2 * np.pi) + over * (1 / 12 - over * over * (1 / 360 - over * over / 1260))
    out[k] -= np.log(low)
    return out


@lru_cache(maxsize=len(DISCOUNTS) + 2)
def _seatings(discount: float) -> np.ndarray:
    """log of the weighted number of ways to seat c customers at t tables, c and t up to EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore"):
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], table[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    return table


def _saddle(y: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of phi(x) = (1 - (1-x)^d) / d at x = 1 - exp(-y): log phi, r = x phi' / phi, and x dr/dx."""
    x, z = -np.expm1(-y), -np.expm1(-d * y)
    r = x * d * np.exp((1 - d) * y) / z
    with np.errstate(over="ignore"):
        return np.log(z / d), r, r * (1 + (1 - d) * x * np.exp(y) - r)


@lru_cache(maxsize=len(DISCOUNTS) + 2)
def _curve(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log r for many y."""
    y = np.geomspace(1e-10, 600, 4000)
    return np.log(_saddle(y, d)[1]), y


def _point(ratio: np.ndarray, d: float) -> np.ndarray:
    """y with r = ratio (customers per table): read off the curve, then two steps of Newton's method."""
    target, (logs, ys) = np.log(ratio), _curve(d)
    y = np.interp(target, logs, ys)
    for _ in range(2):
        _, r, spread = _saddle(y, d)
        y = np.clip(y - (np.log(r) - target) * r * np.expm1(y) / np.maximum(spread, 1e-300), 0.5 * y, 2 * y)
    return y


def _saddle_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The logarithm by the saddle point of the generating function phi^t / t!."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    y = _point(np.maximum(c / t, 1 + 1e-9), d)
    log_phi, _, spread = _saddle(y, d)
    out = _log_gamma(c + 1) - _log_gamma(t + 1) + t * log_phi - c * np.log(-np.expm1(-y)) - 0.5 * np.log(2 * np.pi * np.maximum(t * spread, 1e-9))
    return np.where(t >= c, 0.0, out)  # each at a table alone: one way


@lru_cache(maxsize=len(DISCOUNTS) + 2)
def _error(d: float) -> np.ndarray:
    """By how much the saddle point falls short at EXACT customers, for t from 1; it depends on t / c^d."""
    t = np.arange(1, EXACT + 1)
    return _seatings(d)[EXACT, 1:] - _saddle_seatings(np.full(EXACT, EXACT), t, d)


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the weighted number of ways to seat c customers at t tables: exact up to EXACT; beyond, by the saddle point, corrected by its error at EXACT."""
    out = np.empty(len(c))
    small = c <= EXACT
    out[small] = _seatings(d)[c[small], t[small]]
    c, t = c[~small], t[~small]
    if len(c):
        beyond = _saddle_seatings(c, t, d) + np.interp(t * (EXACT / c) ** d, np.arange(1, EXACT + 1), _error(d))
        out[~small] = np.where(t == 1, _log_gamma(c - d) - _log_gamma(np.full(1, 1 - d)), beyond)
    return out


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, all seated anew, given the tables of their restaurants' other dishes and the parent's probabilities."""
    out, order = np.minimum(c, 1).astype(np.int64), np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    cuts = np.append(np.flatnonzero(np.diff(c[order], prepend=-1)), len(order))
    for x, y in zip(cuts, cuts[1:], strict=False):
        n = int(c[order[x]])
        if n > PLAIN:
            break
        if n == 2:  # one table or two
            k = order[x:y]
            two = (strength + discount * (others[k] + 1)) * p[k]
            out[k] += 1 - discount < rng.random(len(k)) * (1 - discount + two)
            continue
        ways = np.exp(_seatings(discount)[n, 1 : n + 1])  # no weight is out of range
        for at in range(x, y, 100_000 // n + 1):
            k = order[at : min(y, at + 100_000 // n + 1)]
            cum = np.cumsum(ways * np.cumprod((strength + discount * (others[k, None] + np.arange(n))) * p[k, None], axis=1), axis=1)
            out[k] = 1 + (cum < rng.random((len(k), 1)) * cum[:, -1:]).sum(1)
    at, end = np.searchsorted(c[order], (PLAIN + 1, EXACT + 1)).tolist()
    while at < end:  # dishes of up to a quarter more customers are weighed together; more tables than customers have no weight
        n = int(c[order[at]] * 5 // 4)
        k = order[at : min(end, at + 100_000 // n + 1)]
        k = k[: np.searchsorted(c[k], n, side="right")]
        n = int(c[k[-1]])
        logs = _seatings(discount)[c[k], 1 : n + 1] + np.cumsum(np.log((strength + discount * (others[k, None] + np.arange(n))) * p[k, None]), axis=1)
        cum = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
        out[k] = 1 + (cum < rng.random((len(k), 1)) * cum[:, -1:]).sum(1)
        at += len(k)
    large = order[np.searchsorted(c[order], EXACT + 1) :]
    if len(large):
        out[large] = _draw_large(c[large], others[large], p[large], discount, strength, rng)
    return np.minimum(out, c)


def _draw_large(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """The same for dishes of more than EXACT customers: on a grid of GRID table numbers around the likeliest, or on all up to GRID."""
    held, n = others + strength / d, c.astype(np.float64)

    def slope(t: np.ndarray) -> np.ndarray:
        """How the logarithm of the weight changes with t."""
        return _saddle(_point(np.maximum(n / t, 1 + 1e-9), d), d)[0] - np.log(t) + np.log(held + t) + np.log(d * p)

    low, high = np.ones(len(c)), n - 0.5
    for _ in range(40):
        mid = 0.5 * (low + high)
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    step = np.maximum(0.5, 0.01 * mid)
    bend = (slope(np.maximum(mid - step, 0.5)) - slope(np.minimum(mid + step, n - 0.25))) / (np.minimum(mid + step, n - 0.25) - np.maximum(mid - step, 0.5))
    spread = 1 / np.sqrt(np.maximum(bend, 1e-12))
    first = np.where(mid + 6 * spread < GRID, 1, np.maximum(1, np.floor(mid - 6 * spread)))
    width = np.where(first == 1, 1, np.maximum(1, np.ceil((12 * spread + 1) / GRID)))
    t = np.clip(first[:, None] + width[:, None] * np.arange(GRID), 1, n[:, None]).astype(np.int64)
    flat = t.ravel()
    at = np.repeat(np.arange(len(c)), GRID)
    logs = log_seatings(c[at], flat, d) + _log_gamma(held[at] + flat) - _log_gamma(held[at]) + flat * np.log(d * p[at])
    logs = logs.reshape(t.shape)
    logs[:, 1:][t[:, 1:] == t[:, :-1]] = -np.inf
    cum = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
    k = np.minimum((cum < rng.random((len(c), 1)) * cum[:, -1:]).sum(1), GRID - 1)
    return np.clip(t[np.arange(len(c)), k] + np.floor(rng.random(len(c)) * width).astype(np.int64), 1, c)


#: Table numbers that are weighed for a large dish.
GRID = 128


def log_likelihoods(dishes: tuple[np.ndarray, np.ndarray], tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """log-likelihood of a level's seating for each discount and strength of the grid: dishes are (c, t), tables and customers those of its restaurants."""
    (pairs, n), (ts, nt), (cs, nc) = (np.unique(x, return_counts=True) for x in (dishes[0].astype(np.int64) << 32 | dishes[1].astype(np.int64), tables[tables > 0], customers[customers > 0]))
    c, t = pairs >> 32, pairs & 0xFFFFFFFF
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    closed = [float((nc * (_log_gamma(s + cs) - _log_gamma(np.full(1, s + 1)))).sum()) for s in STRENGTHS]
    for i, d in enumerate(DISCOUNTS):
        seats = float((n * log_seatings(c, t, d)).sum())
        for j, s in enumerate(STRENGTHS):
            opened = float((nt * ((ts - 1) * np.log(d) + _log_gamma(s / d + ts) - _log_gamma(np.full(1, s / d + 1)))).sum())
            out[i, j] = seats + opened - closed[j]
    return out


def draw_grid(logs: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """(discount, strength) drawn by their likelihoods, all points of the grid being alike beforehand."""
    weights = np.exp(logs - logs.max()).ravel()
    k = int(rng.choice(len(weights), p=weights / weights.sum()))
    return DISCOUNTS[k // len(STRENGTHS)], STRENGTHS[k % len(STRENGTHS)]


class Merged:
    """The distinct triples that chunks ask a part for, and their restaurants."""

    def __init__(self, asked: Sequence[bytes | Sequence[np.ndarray]], deal: Deal) -> None:
        """asked: what `unpack_triples` returns, or the same packed as it is."""
        read = [_unpack(x, *["<u4"] * 5) if isinstance(x, bytes) else x for x in asked]
        u2, u1, times, w, n = (np.concatenate(x) for x in zip(*read, strict=True))
        self.lengths = [len(r[3]) for r in read]
        split = lambda x, bits: ((x >> np.uint64(bits)).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64))
        (parents, of), wide = _ranked(u2), int(u1.max(initial=0)).bit_length()
        contexts, of = _ranked(of << wide | u1)
        self.parent = split(contexts, wide)[0]
        self.words, word = _ranked(w)
        wide = len(self.words).bit_length()
        keys, self.place = _ranked(np.repeat(of, times) << wide | word)
        self.context, self.word = split(keys, wide)
        self.c = np.bincount(self.place, weights=n).astype(np.int64)  # training customers; 0 for triples of held-out texts alone
        self.n_contexts, self.n_parents = len(contexts), len(parents)
        hot = _places(parents.astype(np.int64), deal.hot)
        pairs, at = _ranked(self.parent[self.context] << wide | self.word)
        there = np.zeros(len(pairs), bool)
        there[at[(self.c > 0) | (hot >= 0)[self.parent][self.context]]] = True  # a shared restaurant may have customers elsewhere
        self.pair = np.where(there, np.cumsum(there) - 1, -1)[at]  # the dish one level up, -1 where it has no customers
        self.pair_parent, self.pair_word = split(pairs[there], wide)
        self.pair_hot = hot[self.pair_parent]

    def dishes(self) -> tuple[np.ndarray, ...]:
        """What the sweeps need: dishes of one customer have one table for good and are but counted."""
        one, many = self.c == 1, self.c > 1
        count = lambda x, n: np.bincount(x, minlength=n).astype("<u4")
        customers, times = np.unique(np.bincount(self.context, weights=self.c, minlength=self.n_contexts).astype("<u4"), return_counts=True)
        return (
            count(self.context[one], self.n_contexts), count(self.pair[one], len(self.pair_word)), self.context[many].astype("<u4"), self.pair[many].astype("<u4"), self.c[many].astype("<u4"),
            self.pair_parent.astype("<u4"), self.pair_word.astype("<u4"), (self.pair_hot + 1).astype("<u4"), customers, times.astype("<u4"), np.array([self.n_parents, len(self.words)], "<u4"),
        )

    def static(self) -> bytes:
        """The same, packed."""
        return _pack(*self.dishes(), level=HARD)


class Whole(NamedTuple):
    """Customers and tables of the shared restaurants, by their place among the hot words."""

    customers: np.ndarray
    tables: np.ndarray


class Part:
    """A part's seating: tables of dishes with two customers or more (t3) and of their parents' dishes (t2); those of dishes of shared restaurants (hot: which, otherwise -1) are 0 here."""

    def __init__(self, static: bytes | Sequence[np.ndarray]) -> None:
        self.ones3, self.ones2, self.context, self.pair, c3, self.parent, self.word, hot, self.customers, self.times, sizes = (x.astype(np.int64) for x in (_unpack(static, *["<u4"] * 11) if isinstance(static, bytes) else static))
        self.c3, (self.n_parents, self.n_words) = c3, sizes.tolist()
        self.hot, self.own = hot - 1, hot == 0
        self.t3, self.t2 = np.ones(len(c3), np.int64), self.own.astype(np.int64)
        self.bounds = np.searchsorted(self.parent, np.arange(self.n_parents + 1))  # dishes stand restaurant by restaurant

    def tables3(self) -> np.ndarray:
        return self.ones3 + np.bincount(self.context, weights=self.t3, minlength=len(self.ones3)).astype(np.int64)

    def tables2(self) -> np.ndarray:
        return self.summed(self.t2)

    def summed(self, x: np.ndarray) -> np.ndarray:
        """Sums of whole numbers of the parents' dishes over each restaurant."""
        return np.diff(np.append(0, np.cumsum(x))[self.bounds])

    def dishes2(self) -> np.ndarray:
        """Customers of the parents' dishes from the contexts of this part."""
        return self.ones2 + np.bincount(self.pair, weights=self.t3, minlength=len(self.word)).astype(np.int64)

    def c2(self) -> np.ndarray:
        """The same, 0 for dishes that are seated elsewhere."""
        return np.where(self.own, self.dishes2(), 0)

    def shared(self, words: np.ndarray, word_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The dishes of shared restaurants in the order of the parts of words, and bounds."""
        k = np.flatnonzero(~self.own)
        order, bounds = _dealt(words[self.word[k]], word_parts)
        return k[order], bounds

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.t2, minlength=self.n_words).astype("<u4")

    def parents(self, level2: tuple[float, float], x2: np.ndarray | None, whole: Whole | None) -> tuple[np.ndarray, np.ndarray]:
        """Of the parents' dishes, c - d t and the restaurant's weight on the root, both over theta + C. x2: c - d t of shared restaurants' dishes."""
        c2, t2 = self.c2(), self.tables2()
        own = self.summed(c2)
        customers, tables, x = own[self.parent], t2[self.parent], c2 - level2[0] * self.t2
        if whole is not None and not self.own.all():
            k = np.flatnonzero(~self.own)
            customers, tables, x = customers.astype(np.float64), tables.astype(np.float64), x.astype(np.float64)
            customers[k], tables[k], x[k] = whole.customers[self.hot[k]], whole.tables[self.hot[k]], x2[k]
        over = level2[1] + customers
        return x / over, (level2[1] + level2[0] * tables) / over

    def sweep(self, p0: np.ndarray, level2: tuple[float, float], level3: tuple[float, float], rng: np.random.Generator, x2: np.ndarray | None = None, whole: Whole | None = None) -> None:
        """Seats all customers of every dish anew, in SHARES shares of each level, so that dishes see most others' new tables."""
        here, above = self.parents(level2, x2, whole)
        p2 = here + above * p0[self.word]
        turn = rng.integers(0, SHARES, len(self.c3))
        for share in range(SHARES):
            k = np.flatnonzero(turn == share)
            self.t3[k] = draw_tables(self.c3[k], self.tables3()[self.context[k]] - self.t3[k], p2[self.pair[k]], *level3, rng)
        c2, turn = self.c2(), rng.integers(0, SHARES, len(self.t2))
        self.t2 = np.minimum(self.t2, c2)
        for share in range(SHARES):
            k = np.flatnonzero((turn == share) & (c2 > 1))
            self.t2[k] = draw_tables(c2[k], self.tables2()[self.parent[k]] - self.t2[k], p0[self.word[k]], *level2, rng)

    def likelihoods(self) -> np.ndarray:
        c2 = self.c2()
        level2 = log_likelihoods((c2[self.own], self.t2[self.own]), self.tables2(), self.summed(c2))
        level3 = log_likelihoods((self.c3, self.t3), self.tables3(), np.repeat(self.customers, self.times))
        return np.concatenate((level2.ravel(), level3.ravel()))


def root_probability(x: np.ndarray, level: tuple[float, float], customers: float, tables: float, v: int) -> np.ndarray:
    """p(w) in the root, where x is c - d t of its dish."""
    return (x + (level[1] + level[0] * tables) / (v + 1)) / (level[1] + customers)


def probabilities(m: Merged, p: Part, p0: np.ndarray, level2: tuple[float, float], level3: tuple[float, float], x2: np.ndarray | None = None, whole: Whole | None = None) -> np.ndarray:
    """p(w | u1 u2) of all triples of m in the seating p."""
    t2, t3 = p.tables2(), p.tables3()
    own2 = p.summed(p.c2())
    own3 = np.bincount(m.context, weights=m.c, minlength=m.n_contexts)
    parent = m.parent[m.context]
    p2 = ((level2[1] + level2[0] * t2) / (level2[1] + own2))[parent] * p0[m.word]
    known = np.flatnonzero(m.pair >= 0)
    here, above = p.parents(level2, x2, whole)
    p2[known] = (here + above * p0[p.word])[m.pair[known]]
    tables = np.minimum(m.c, 1)
    tables[m.c > 1] = p.t3
    return (m.c - level3[0] * tables + (level3[1] + level3[0] * t3[m.context]) * p2) / (level3[1] + own3[m.context])


def merge(asked: DataFrame, deal: Deal, word_parts: int) -> DataFrame:
    """kind 0: a part's dishes; kind 2: its words; kind 6 (chunk: the asking part): its words, to the parts of words, with a table for each context of one word; kind 9: dishes of shared restaurants (their place among the hot words, word and first customers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts_of(batches):
            m = Merged([unpack_triples(body) for *_, body in rows], deal)
            dishes = m.dishes()
            static, p = _pack(*dishes, level=HARD), Part(dishes)
            del dishes, m.place, m.context, m.pair, m.word, m.c
            yield _messages([(None, part, 0, static), (None, part, 2, _pack(m.words.astype("<u4")))])
            order, bounds = _dealt(m.words, word_parts)
            here = p.root_customers()
            yield _messages([(part, q, 6, _pack(m.words[order[bounds[q] : bounds[q + 1]]].astype("<u4"), here[order[bounds[q] : bounds[q + 1]]])) for q in np.flatnonzero(np.diff(bounds)).tolist()])
            k, bounds = p.shared(m.words, word_parts)
            cells = (m.pair_hot[k].astype("<u4"), m.words[m.pair_word[k]].astype("<u4"), p.dishes2()[k].astype("<u4"))
            yield from _some([(part, q, 9, _pack(*(x[bounds[q] : bounds[q + 1]] for x in cells))) for q in np.flatnonzero(np.diff(bounds)).tolist()])

    return map_batches(_by_part(asked, deal.parts), run, _MESSAGE)


def root(told: DataFrame, word_parts: int, number: int, level: tuple[float, float], tables: float, v: int, level2: tuple[float, float], whole: Whole, was: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Seats the dishes of shared restaurants, whose words are here, and then the root. kind 7 (chunk: the part of words): to parts, c - d t of their words; kind 13: of their dishes of shared restaurants; kind 12: what the next call takes on; kind 5: a part's customers and tables of the root and of each shared restaurant and, in burn-in, likelihoods. From kinds 6 and 9 and, after a sweep, 8, 11 and 12.

    whole, was: the shared restaurants, and the root's level and sums, as the call before has left them."""
    n_hot = len(whole.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts_of(batches):
            asked = {chunk: _unpack(body, "<u4", "<u4") for chunk, kind, body in rows if kind == 6}
            now = {chunk: x[1] for chunk, x in asked.items()} | {chunk: _unpack(body, "<u4")[0] for chunk, kind, body in rows if kind == 8}
            words, where = _ranked(np.concatenate([x[0] for x in asked.values()]))
            c = np.bincount(where, weights=np.concatenate([now[k] for k in asked])).astype(np.int64)
            rng = np.random.default_rng((SEED, 1, part, number))
            before = next((_unpack(body, "<u4", "<u4") for _, kind, body in rows if kind == 12), None)
            shared = {chunk: _unpack(body, "<u4", "<u4", "<u4") for chunk, kind, body in rows if kind == 9}
            c2 = t2 = hot = np.empty(0, np.int64)
            if shared:
                last = {chunk: x[2] for chunk, x in shared.items()} | {chunk: _unpack(body, "<u4")[0] for chunk, kind, body in rows if kind == 11}
                dishes, at2 = _ranked(np.concatenate([x[0].astype(np.uint64) << np.uint64(32) | x[1] for x in shared.values()]))
                hot, w = (dishes >> np.uint64(32)).astype(np.int64), np.searchsorted(words, dishes & np.uint64(0xFFFFFFFF))
                c2 = np.bincount(at2, weights=np.concatenate([last[k] for k in shared])).astype(np.int64)
                t2 = np.minimum(c2, 1)
                if before is not None:
                    p0 = root_probability(before[1].view("<f4").astype(np.float64), was[0], *was[1], v)
                    t2 = draw_tables(c2, np.maximum(whole.tables[hot] - np.minimum(before[0], c2), 0), p0[w], *level2, rng)
                c += np.bincount(w, weights=t2, minlength=len(words)).astype(np.int64)
                x2, at = _shortened(c2 - level2[0] * t2, 12), 0
                for chunk, x in shared.items():
                    yield _messages([(part, chunk, 13, _pack(x2[at2[at : at + len(x[0])]]))])
                    at += len(x[0])
            t = draw_tables(c, np.full(len(c), max(0.0, tables - 1)), np.full(len(c), 1 / (v + 1)), *level, rng)
            x, at = _shortened(c - level[0] * t, 16), 0
            for chunk, mine in asked.items():
                yield _messages([(part, chunk, 7, _pack(x[where[at : at + len(mine[0])]]))])
                at += len(mine[0])
            if shared and number < BURN_IN + SAMPLES:
                yield _messages([(None, part, 12, _pack(t2.astype("<u4"), x))])
            seats = [_seats(*dishes) for dishes in ((c, t), (c2, t2))] if number < BURN_IN else np.zeros((2, len(DISCOUNTS)))
            yield _messages([(None, part, 5, _pack(np.concatenate(([c.sum(), t.sum()], *seats, *(np.bincount(hot, x, n_hot) for x in (c2, t2))))))])

    return map_batches(_by_part(told, word_parts), run, _MESSAGE)


def _seats(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of the weighted number of ways to seat all dishes, for each discount of the grid."""
    pairs, n = np.unique(c[c > 0] << 32 | t[c > 0], return_counts=True)
    return np.array([float((n * log_seatings(pairs >> 32, pairs & 0xFFFFFFFF, d)).sum()) for d in DISCOUNTS])


def sums(messages: DataFrame, kind: int, n: int) -> np.ndarray:
    """Sums of n numbers over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            for body in b.column("body").to_pylist():
                total += _unpack(body, "<f8")[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(total)], names=["k", "x"])

    got = {r.k: r.x for r in map_batches(messages.filter(F.col("kind") == kind).select("body"), run, _SUMS).groupBy("k").agg(F.sum("x").alias("x")).collect()}
    return np.array([got.get(k, 0.0) for k in range(n)])


def _told(rows: list[tuple[int, int, bytes]], kind: int, words: int, order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """c - d t of a part's words in the root, or of its dishes in shared restaurants."""
    out = np.zeros(words)
    for q, k, body in rows:
        if k == kind:
            out[order[bounds[q] : bounds[q + 1]]] = _unpack(body, "<u4")[0].view("<f4")
    return out


def sweep_parts(rows: DataFrame, parts: int, number: int, levels: Sequence[tuple[float, float]], root_sums: tuple[float, float], v: int, word_parts: int, whole: Whole) -> DataFrame:
    """One sweep over all parts. kind 1: a part's seating, and those of samples before it; kind 8: its customers of the root, to the parts of words; kind 11: those of shared restaurants; kind 4, in burn-in: its likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, mine in _parts_of(batches):
            p = Part(next(body for _, kind, body in mine if kind == 0))
            before = [x for _, kind, body in mine if kind == 1 for x in _unpack(body, *["<u4"] * 2 * max(1, number - BURN_IN))]
            if before:
                p.t3, p.t2 = before[-2].astype(np.int64), before[-1].astype(np.int64)
            words = _unpack(next(body for _, kind, body in mine if kind == 2), "<u4")[0]
            (order, bounds), (dishes, cuts) = _dealt(words, word_parts), p.shared(words, word_parts)
            p0 = root_probability(_told(mine, 7, p.n_words, order, bounds), levels[0], *root_sums, v)
            p.sweep(p0, levels[1], levels[2], np.random.default_rng((SEED, 2, part, number)), _told(mine, 13, len(p.word), dishes, cuts), whole)
            kept = [*(before if number > BURN_IN else ()), p.t3.astype("<u4"), p.t2.astype("<u4")]
            yield _messages([(None, part, 1, _pack(*kept))])
            here = p.root_customers()[order]
            yield _messages([(part, q, 8, _pack(here[bounds[q] : bounds[q + 1]])) for q in np.flatnonzero(np.diff(bounds)).tolist()])
            here = p.dishes2()[dishes].astype("<u4")
            yield from _some([(part, q, 11, _pack(here[cuts[q] : cuts[q + 1]])) for q in np.flatnonzero(np.diff(cuts)).tolist()])
            if number < BURN_IN:
                yield _messages([(None, part, 4, _pack(p.likelihoods()))])

    return map_batches(_by_part(rows, parts), run, _MESSAGE)


def replies(rows: DataFrame, deal: Deal, word_parts: int, samples: Sequence[tuple[Sequence[tuple[float, float]], tuple[float, float], Whole]], v: int) -> DataFrame:
    """kind 1: to chunks, the averaged probability of each triple asked for, to 12 bits of precision. Samples are (levels, sums of the root, shared restaurants); the root's words come as kind 70, 71 and so on, dishes of shared restaurants as kind 130, 131 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, mine in _parts_of(batches):
            asked = [(chunk, body) for chunk, kind, body in mine if kind == 0]
            m = Merged([unpack_triples(body) for _, body in asked], deal)
            p = Part(m.dishes())
            seated = _unpack(next(body for _, kind, body in mine if kind == 1), *["<u4"] * 2 * SAMPLES)
            (order, bounds), (dishes, cuts) = _dealt(m.words, word_parts), p.shared(m.words, word_parts)
            whole = np.zeros(len(m.c))
            for s, (levels, root_sums, shared) in enumerate(samples):
                p.t3, p.t2 = (x.astype(np.int64) for x in seated[2 * s : 2 * s + 2])
                p0 = root_probability(_told(mine, 70 + s, p.n_words, order, bounds), levels[0], *root_sums, v)
                x2 = _told(mine, 130 + s, len(p.word), dishes, cuts)
                whole += probabilities(m, p, p0, levels[1], levels[2], x2, shared) / len(samples)
            bits, at = _shortened(whole, 12), 0
            for (chunk, _), n in zip(asked, m.lengths, strict=True):
                yield _messages([(chunk, part, 1, _pack(bits[m.place[at : at + n]]))])
                at += n

    return map_batches(_by_part(rows, deal.parts), run, _MESSAGE)


# 5. Scores


def score_chunks(numbered: DataFrame, answers: DataFrame, deal: Deal, n_all: int, v_all: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "chunk", ("part", "kind", "body")):
            c = Chunk(next(body for _, kind, body in rows if kind == 0), numbered=True)
            c.triples(c.words, deal)
            p = np.zeros(len(c.w))
            for part, kind, body in rows:
                if kind == 1:
                    p[c.bounds[part] : c.bounds[part + 1]] = _unpack(body, "<u4")[0].view("<f4")
            counts = c.known_counts
            add = lambda x: np.add.reduceat(x, c.starts)
            base = np.log10((counts + 1) / (n_all + v_all + 1))
            cells = (
                pa.array(c.doc_ids, mask=~c.known_ids), pa.array(c.held), pa.array(c.lengths), pa.array(add((counts > 0)[c.tokens].astype(np.int64))),
                pa.array(np.full(len(c.lengths), n_all, np.int64)), pa.array(add(base[c.tokens])), pa.array(add(np.log10(p)[c.place])),
            )
            yield pa.RecordBatch.from_arrays(list(cells), names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(_by_chunk(numbered, answers), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, learnt from those not held out."""
    spark = docs.sparkSession
    folder, rng = f"{checkpoint_dir(spark)}/hpylm-{uuid.uuid4().hex}", np.random.default_rng(SEED)

    def collected() -> None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets go of the shuffles behind what is written

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        collected()
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def dropped(*names: str) -> None:
        for name in names:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    stored = written(chunks(docs), "chunks")
    n_docs, n_tokens = (int(x or 0) for x in stored.agg(F.sum("n_docs"), F.sum("n_tokens")).first())
    parts = max(16, -(-n_tokens // PER_PART))
    word_parts = max(8, parts // PARTS_TO_WORDS)
    words = written(vocabulary(stored, word_parts), "words")
    n_all, v_all, hot = counts_and_hot(words)
    if n_docs > PER_PART:
        hot[BEGIN] = n_docs
    numbers = np.array(sorted(hot), np.int64)
    deal = Deal(parts, numbers, np.array([min(2**_CLASS_BITS - 1, -(-2 * hot[k] // PER_PART)) for k in numbers.tolist()], np.int64))
    requests(stored, words, deal, word_parts).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/asked")
    del stored, words
    collected()
    dropped("chunks", "words")
    one = "chunk long, part int, body binary"
    there = bool(n_tokens)
    asked, numbered = (spark.read.schema(one).parquet(f"{folder}/asked/kind={k}").withColumn("kind", F.lit(k)).select("chunk", "part", "kind", "body") if there else spark.createDataFrame([], _MESSAGE) for k in (0, 10))
    merged = written(merge(asked, deal, word_parts), "merged")
    levels, tables, seated, rooted, samples, roots = list(START), float(v_all), None, None, [], []
    whole, was = Whole(np.zeros(len(numbers)), np.zeros(len(numbers))), (START[0], (0.0, 0.0))
    for number in range(BURN_IN + SAMPLES + 1):
        told = merged.filter("kind IN (6, 9)")
        if seated is not None:
            told = told.unionByName(seated.filter("kind IN (8, 11)")).unionByName(rooted.filter("kind = 12"))
        rooted = written(root(told, word_parts, number, levels[0], tables, v_all, levels[1], whole, was), f"root{number}")
        if number and number - 1 <= BURN_IN:
            dropped(f"root{number - 1}")
        customers, tables, *rest = sums(rooted, 5, 2 + 2 * len(DISCOUNTS) + 2 * len(numbers))
        seats, (shared_customers, shared_tables) = np.array(rest[: 2 * len(DISCOUNTS)]).reshape(2, -1), np.array(rest[2 * len(DISCOUNTS) :]).reshape(2, -1)
        whole, was = Whole(shared_customers, shared_tables), (levels[0], (customers, tables))
        if number > BURN_IN:
            samples.append((tuple(levels), (customers, tables), whole))
            again = F.when(F.col("kind") == 7, 69 + len(samples)).otherwise(129 + len(samples))
            roots.append(rooted.filter("kind IN (7, 13)").withColumn("kind", again))
        if number == BURN_IN + SAMPLES:
            break
        rows = merged.filter("kind IN (0, 2)").unionByName(rooted.filter("kind IN (7, 13)"))
        if seated is not None:
            rows = rows.unionByName(seated.filter("kind = 1"))
        seated = written(sweep_parts(rows, parts, number, levels, (customers, tables), v_all, word_parts, whole), f"sweep{number}")
        if number:
            dropped(f"sweep{number - 1}")
        if number < BURN_IN and n_all:  # samples share the levels that burn-in has led to
            none = np.empty(0, np.int64)
            of_root, of_shared = (log_likelihoods((none, none), np.array(t, np.int64), np.array(c, np.int64)) + s[:, None] for t, c, s in (([tables], [customers], seats[0]), (shared_tables, shared_customers, seats[1])))
            level2, level3 = sums(seated, 4, 2 * of_root.size).reshape(2, *of_root.shape)
            levels = [draw_grid(x, rng) for x in (of_root, level2 + of_shared, level3)]
    rows = asked.unionByName(seated.filter("kind = 1"))
    for r in roots:
        rows = rows.unionByName(r.select(rows.columns))
    dropped("merged")
    answers = written(replies(rows, deal, word_parts, samples, v_all), "replies")
    dropped("asked/kind=0")
    return score_chunks(numbered, answers, deal, n_all, v_all)
