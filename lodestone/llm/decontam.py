"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words at the ones of a fixed mask; words at its zeros may differ. Seeds of the benchmark items
and of the documents are joined; around every hit the words of both are laid side by side, and a window of WINDOW words
(all words of a shorter item) with at least IDENTITY of them equal makes an overlap. Words are runs of letters and
digits, A-Z lower-cased, as 64-bit hashes.

Which masks an item gets depends on its length (`masks_for`). They are chosen so that every window with enough equal
words holds a hit, wherever the others stand: recall is 1 for every length, up to items of fewer than EXACT words, where
only the whole item, word for word, is an overlap.

The documents' side of the join is thinned by a bitmap of the benchmark's seeds. It has a fixed size; the more seeds
there are, the less it thins, and the join alone decides. Seeds that hit lie close together where a passage was copied,
so a document's hits are grouped into regions of SPAN words at most that carry their words with them: texts are never
shuffled, and a region is laid beside an item once per shift.

Edge cases: null, empty and short texts hold no window and are clean; items without words match nothing; repeated rows
and doc_ids are searched all, each against its own words, and a doc_id (null as well) has one row per item; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ROW, cut, keyed, map_batches, without
from lodestone.llm.hashing import ALPHANUMERIC, combine, hashes_of

WINDOW, IDENTITY = 13, 0.8
#: Items of fewer words are matched whole and word for word.
EXACT = 8
#: Masks of items of WINDOW words or more (a 13-word window may differ in two), and of shorter ones.
LONG_MASKS = ("11101011", "11001111")
SHORT_MASKS = ("111011", "11010011", "11111")
#: Items of fewer words condemn no document in `clean`: such words stand together by chance.
SHORTEST = 4
#: Words of a region.
SPAN = 1024
#: Of the bitmap: 2**27 bits are 16 MB, whatever the benchmark's size.
BITMAP_BITS = 27
#: Up to this many benchmark seeds are broadcast in the join; beyond, it is a shuffle join.
BROADCAST_SEEDS = 500_000
ALL_MASKS = (*LONG_MASKS, *SHORT_MASKS, *("1" * n for n in range(1, EXACT)))
_OFFSETS = tuple(tuple(i for i, x in enumerate(m) if x == "1") for m in ALL_MASKS)
_REACH = max(map(len, ALL_MASKS)) + WINDOW
_SEED_SCHEMA = "item_id long, item_at int, kind int, seed long"
_REGION_SCHEMA = "region long, doc_id long, words binary, seeds array<struct<seed:long,at:int>>, start long"


@lru_cache(maxsize=64)
def masks_for(n: int) -> tuple[int, ...]:
    """The masks of an item of n words, as places in ALL_MASKS."""
    if n >= WINDOW:
        return tuple(range(len(LONG_MASKS)))
    if n >= EXACT:
        return tuple(range(len(LONG_MASKS), len(LONG_MASKS) + len(SHORT_MASKS)))
    return (len(ALL_MASKS) - EXACT + n,) if n else ()


def _seeds(h: np.ndarray, kinds: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    for k in kinds:
        yield k, combine(h, _OFFSETS[k]) + np.uint64(k)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words: the hashes of an item's words, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: list[bytes] = [b""] * b.num_rows
            for i, h in hashes_of(_texts(b), ALPHANUMERIC):
                words[i] = h.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(words, pa.binary())], names=["item_id", "words"])

    return map_batches(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, words binary")


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, item_at (the word at which the seed begins), kind (its mask), seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column("item_id").to_pylist(), b.column("words").to_pylist(), strict=True):
                h = np.frombuffer(words, dtype=np.uint64)
                for k, seeds in _seeds(h, masks_for(len(h))):
                    cells = (pa.array([item] * len(seeds), pa.int64()), pa.array(np.arange(len(seeds), dtype=np.int32)), pa.array(np.full(len(seeds), k, np.int32)), pa.array(seeds.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(list(cells), names=["item_id", "item_at", "kind", "seed"])

    return map_batches(items, run, _SEED_SCHEMA)


def seed_bitmap(seeds: DataFrame) -> bytes:
    """2**BITMAP_BITS bits, one set for every seed; made in Spark as 64-bit words, of which the driver gets each once at most."""
    top = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    words = seeds.select(F.shiftright(top, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 64 - {0}) & 63 as int))".replace("{0}", str(BITMAP_BITS))).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    got = words.toArrow()
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return table.tobytes()


def hit_regions(docs: DataFrame, bitmap: bytes, kinds: Sequence[int], key: str) -> DataFrame:
    """region (a number of its own), doc_id (the key), words (hashes of the words of the region and those around it), seeds in it, and its first word's place in the text."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, number = np.frombuffer(held.value, dtype=np.uint64), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for i, h in hashes_of(_texts(b), ALPHANUMERIC):
                at, seeds = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for _, s in _seeds(h, kinds):
                    top = s >> np.uint64(64 - BITMAP_BITS)
                    hit = np.flatnonzero((bits[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1))
                    at.append(hit)
                    seeds.append(s[hit])
                places = np.concatenate(at)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, found = places[order], np.concatenate(seeds)[order]
                cuts = [0, *(np.flatnonzero((np.diff(places) > WINDOW) | (np.diff(places // SPAN) > 0)) + 1).tolist(), len(places)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    low, high = max(0, int(places[x]) - WINDOW), int(places[y - 1]) + _REACH
                    local = (places[x:y] - low).tolist()
                    rows.append((number, ids[i], h[low:high].tobytes(), [{"seed": s, "at": p} for s, p in zip(found[x:y].view(np.int64).tolist(), local, strict=True)], low))
                    number += 1
            if rows:
                kinds_of = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=["region", "doc_id", "words", "seeds", "start"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), "text"), run, _REGION_SCHEMA)


def best_window(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal words, window, place in words) of the best window when item[0] lies at words[shift]."""
    window = min(WINDOW, len(item))
    low, high = max(0, shift), min(len(words), shift + len(item))
    if high - low < window:
        return 0, window, low
    sums = np.concatenate(([0], np.cumsum(words[low:high] == item[low - shift : high - shift])))
    scores = sums[window:] - sums[:-window]
    best = int(scores.argmax())
    return int(scores[best]), window, low + best


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, item_id, equal_words, window, doc_word, item_word: the best overlap of each document with each item that it holds a passage of."""
    items = cut(item_words(benchmark))
    seeds = cut(item_seeds(items))
    bitmap = seed_bitmap(seeds)
    per_kind = {r.kind: r["count"] for r in seeds.groupBy("kind").count().collect()}  # of a dozen masks
    few = sum(per_kind.values()) <= BROADCAST_SEEDS
    sized = F.broadcast if few else lambda x: x
    regions = cut(hit_regions(docs, bitmap, sorted(per_kind), key))
    hits = regions.select("region", "doc_id", "start", F.inline("seeds")).join(sized(seeds), "seed")
    whole = F.col("kind") >= len(LONG_MASKS) + len(SHORT_MASKS)
    n = (F.col("kind") - (len(ALL_MASKS) - EXACT)).cast("long")
    exact = hits.filter(whole).select("doc_id", "item_id", n.alias("equal_words"), n.alias("window"), (F.col("start") + F.col("at")).alias("doc_word"), F.lit(0).cast("long").alias("item_word"))
    shifts = hits.filter(~whole).select("region", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    placed = shifts.join(regions.select("region", "doc_id", F.col("words").alias("doc_words"), "start"), "region")
    pairs = placed.join(sized(items.withColumnRenamed("words", "item_words")), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, shift, start, dw, iw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "item_id", "shift", "start", "doc_words", "item_words")), strict=True):
                equal, window, place = best_window(np.frombuffer(dw, dtype=np.uint64), np.frombuffer(iw, dtype=np.uint64), shift)
                if equal >= IDENTITY * window:
                    rows.append((doc, item, equal, window, start + place, place - shift))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "equal_words", "window", "doc_word", "item_word"])

    verified = map_batches(pairs.select("doc_id", "item_id", "shift", "start", "doc_words", "item_words"), verify, "doc_id long, item_id long, equal_words long, window long, doc_word long, item_word long")
    best = F.max(F.struct("equal_words", "window", (-F.col("doc_word")).alias("doc_word"), (-F.col("item_word")).alias("item_word"))).alias("best")
    found = verified.unionByName(exact).groupBy("doc_id", "item_id").agg(best)
    return found.select(F.col("doc_id").alias(key), "item_id", "best.equal_words", "best.window", (-F.col("best.doc_word")).alias("doc_word"), (-F.col("best.item_word")).alias("item_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark, of SHORTEST words at least; rows are told apart also where doc_ids are null or repeated."""
    rows, _ = keyed(docs)
    return without(rows, overlaps(rows, benchmark, ROW).filter(F.col("window") >= SHORTEST), ROW).select(docs.columns)
