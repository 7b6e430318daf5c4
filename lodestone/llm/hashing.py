"""64-bit hashes of the words of many texts at once, in numpy, the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: A piece of text that is hashed at once; longer words get a piece of their own.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers by which the words of a shingle or a seed are combined.
MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C8E5D1F3A2B6E47], dtype=np.uint64)

#: Lower-cases A-Z; ASCII white space becomes a space.
SPACED = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z; anything in ASCII but letters and digits becomes a space.
ALPHANUMERIC = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; those of a piece are kept (8 MB), longer ones are made for a long word alone."""
    size = max(2 * PIECE, n)
    if size in _powers:
        return _powers[size]
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if size == 2 * PIECE:
        _powers[size] = (both[0], both[1])
    return both[0], both[1]


def _hash_piece(buf: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes that aren't a space."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(buf, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((buf + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(text: bytes, table: bytes = SPACED) -> np.ndarray:
    """One hash per word of the text, in order; words are what `table` leaves between spaces."""
    text = text.translate(table)
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            if cut < 0:
                cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut + 1
        found.append(_hash_piece(np.frombuffer(text[at:end], dtype=np.uint8)))
        at = end
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def batches_of(texts: Sequence[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def hashes_of(texts: Sequence[bytes], table: bytes = SPACED) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every text, short texts hashed together."""
    for a, b in batches_of(texts):
        if b - a == 1:
            yield a, word_hashes(texts[a], table)
            continue
        parts = [t.translate(table) for t in texts[a:b]]
        joined = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        hashes = _hash_piece(joined)
        space = joined == 32
        begins = np.empty(len(joined), dtype=bool)
        if len(joined):
            begins[0] = not space[0]
            np.logical_and(~space[1:], space[:-1], out=begins[1:])
        word_at = np.flatnonzero(begins)
        stops = np.cumsum([len(p) + 1 for p in parts])
        upto = np.searchsorted(word_at, stops)
        low = 0
        for i, high in enumerate(upto.tolist()):
            yield a + i, hashes[low:high]
            low = high


def combine(h: np.ndarray, offsets: Sequence[int]) -> np.ndarray:
    """A hash of the words at the given offsets, for each position at which all of them exist."""
    n = len(h) - max(offsets)
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(len(offsets)), dtype=np.uint64)
    for k, at in enumerate(offsets):
        total += h[at : at + n] * (MULTIPLIERS[k % len(MULTIPLIERS)] + np.uint64(2 * (k // len(MULTIPLIERS))))
    return mix(total)
