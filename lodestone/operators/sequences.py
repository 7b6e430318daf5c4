"""Local alignment scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.operators.pairs import block_pairs


def smith_waterman(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """The best cell of the alignment table, filled along its anti-diagonals."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n, m = len(x), len(y)
    if not n or not m:
        return 0
    before, last, best = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64), 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.zeros(n + 1, dtype=np.int64)
        same = np.where(x[i - 1] == y[d - i - 1], match, mismatch)
        now[i] = np.maximum(np.maximum(before[i - 1] + same, 0), np.maximum(last[i - 1], last[i]) + gap)
        best = max(best, int(now[i].max()))
        before, last = last, now
    return best


#: Cells of an anti-diagonal, over all pairs, that are filled at once.
CELLS = 1 << 16


def smith_waterman_many(a: Sequence[str], b: Sequence[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """smith_waterman of every pair of a and b; the tables of pairs of like lengths are filled side by side. Shorter sequences are filled up with what matches nothing, which can't raise a score."""
    lengths = [(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    out, order, at = np.zeros(len(lengths), dtype=np.int64), sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True), 0
    while at < len(order):
        some = order[at : at + max(1, CELLS // max(1, lengths[order[at]][0]))]
        at += len(some)
        n, m = lengths[some[0]][0], max(lengths[k][1] for k in some)
        if not n or not m:
            continue
        x, y = np.full((n, len(some)), 0xFFFFFFFF, np.uint32), np.full((m, len(some)), 0xFFFFFFFE, np.uint32)
        for p, k in enumerate(some):
            x[: lengths[k][0], p], y[m - lengths[k][1] :, p] = np.frombuffer(a[k].encode("utf-32-le"), np.uint32), np.frombuffer(b[k].encode("utf-32-le"), np.uint32)[::-1]
        kind = np.int16 if max(n, m) * max(map(abs, (match, mismatch, gap))) < 30000 else np.int64
        before, last, now = (np.zeros((n + 1, len(some)), dtype=kind) for _ in range(3))
        best = np.zeros(len(some), dtype=kind)
        hit, miss, step = kind(match), kind(mismatch), kind(gap)
        for d in range(2, n + m + 1):
            low, high = max(1, d - m), min(n, d - 1)
            same = np.where(x[low - 1 : high] == y[m - d + low : m - d + high + 1], hit, miss)
            same += before[low - 1 : high]
            skip = np.maximum(last[low - 1 : high], last[low : high + 1])
            skip += step
            np.maximum(same, skip, out=same)
            np.maximum(same, 0, out=now[low : high + 1])
            now[low - 1] = 0  # of older diagonals
            if high < n:
                now[high + 1] = 0
            np.maximum(best, now[low : high + 1].max(0), out=best)
            before, last, now = last, now, before
        out[some] = best
    return out


def align_pairs(sequences: DataFrame, blocks: int | None = None) -> DataFrame:
    """a < b, score: of all pairs of sequences (id, s)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"a": p.a, "b": p.b, "score": smith_waterman_many(p.sa.tolist(), p.sb.tolist())})

    pairs = block_pairs(sequences.select("id", "s"), "id", blocks).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.s").alias("sa"), F.col("b.s").alias("sb"))
    return pairs.mapInPandas(score, "a long, b long, score long")


def _seed_lengths(share: float) -> list[tuple[int, int]]:
    """(k, least length): words of k characters, and the length of the shorter sequence from which a pair at or above the share must have one in common; longer words first."""
    longest = max(1, min(12, int(1 / (2 * (1 - share))))) if share < 1 else 12
    found = []
    for k in sorted({longest, 2, 1} - {0}, reverse=True):
        if k <= longest or k == 1:
            n = next((n for n in range(1, 2000) if all(_shared(m, k, share) >= 1 for m in range(n, 2 * n + 50))), None)
            if n is not None:
                found.append((k, n))
    return found


def _shared(n: int, k: int, share: float) -> int:
    """Words of k characters that two sequences have in common at least if they align at `share` of the best score of the shorter, which is of n characters.

    An alignment of M <= n matches and E errors scores 2M - E, so that E <= 2M - S for a score of S or more. Errors part the matches into E + 1 runs at most, which hold M - (k - 1)(E + 1) words or more: least for M = n, and for single characters for M = S / 2."""
    least = math.ceil(2 * n * share - 1e-9)
    return -(-least // 2) if k == 1 else n - (k - 1) * (2 * n - least + 1)


def align_above(sequences: DataFrame, share: float = 0.8) -> DataFrame:
    """a, b, score of all pairs (id, s), a < b, whose alignment scores at least `share` (above 0.5) of the best that the shorter could have, 2 for each of its characters. No such pair is missed, and no other is aligned without having rare words in common.

    Words of k characters are numbered by their occurrence in a sequence. The shorter of a pair asks with its rarest words alone, as many as can't all be missing; the longer answers with all of its own. Empty and null sequences have no pairs."""
    if not 0.5 < share <= 1:
        raise ValueError("share must be above 0.5")
    rows = cut(sequences.filter(F.length("s") > 0).select("id", "s", F.length("s").alias("n")))
    levels, below, found = _seed_lengths(share), None, None
    for k, least in levels:  # shorter words for pairs too short for longer ones
        word = F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.substring("s", i, F.lit(k)))
        own = rows.filter(F.col("n") >= max(k, least)).select("id", "n", F.explode(word).alias("word"))
        counted = own.groupBy("id", "n", "word").agg(F.count("*").alias("times"))
        words = cut(counted.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda j: F.concat("word", F.lit("\x00"), j.cast("string")))).alias("word")))
        often = words.groupBy("word").agg(F.count("*").alias("often"))
        asks = words if below is None else words.filter(F.col("n") < below)
        ranked = asks.join(often, "word").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("w"))
        score_of = F.ceil(2 * F.col("n") * share - 1e-9)
        shared = F.ceil(score_of / 2) if k == 1 else F.col("n") - (k - 1) * (2 * F.col("n") - score_of + 1)
        rare = ranked.select("id", "n", F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - shared.cast("int") + 1, F.lit(1)))).alias("w")).select(F.col("id").alias("short"), F.col("n").alias("sn"), F.col("w.word").alias("word"))
        hits = rare.join(words.select(F.col("id").alias("long"), F.col("n").alias("ln"), "word"), "word").filter("sn < ln OR (sn = ln AND short <> long)")
        pairs = hits.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        below = least if below is None else min(below, least)
    texts = lambda c: rows.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    both = found.distinct().join(texts("a"), "a").join(texts("b"), "b")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"a": p.a, "b": p.b, "score": smith_waterman_many(p.sa.tolist(), p.sb.tolist()), "n": [min(len(x), len(y)) for x, y in zip(p.sa, p.sb, strict=True)]})

    return both.select("a", "b", "sa", "sb").mapInPandas(score, "a long, b long, score long, n long").filter(F.col("score") >= 2 * F.col("n") * share - 1e-9).drop("n")
