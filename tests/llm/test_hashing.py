import random

import numpy as np

from lodestone.llm import hpylm
from lodestone.llm.hashing import PIECE, combine, hashes_of, word_hashes


def test_hashes_do_not_depend_on_batches():
    r = random.Random(2)
    texts = [b"", b"  ", b"One one\tONE\x0btwo", b"x" * (PIECE + 5) + b" one", " ".join("".join(r.choices("abcé", k=r.randint(1, 9))) for _ in range(250_000)).encode(), b"two"]
    got = dict(hashes_of(texts))
    alone = {i: word_hashes(t) for i, t in enumerate(texts)}
    assert all((got[i] == alone[i]).all() and len(got[i]) == len(t.split()) for i, t in enumerate(texts))
    assert got[2][0] == got[2][1] == got[2][2] == got[3][1] and got[2][3] == got[5][0]
    words = texts[4].split()
    assert len(set(words)) == len(np.unique(got[4]))


def test_combine_needs_all_words():
    h = word_hashes(b"a b c d")
    assert len(combine(h, (0, 1, 2))) == 2 and not len(combine(h, range(5)))
    assert combine(h, (0, 2))[0] == combine(word_hashes(b"a x c"), (0, 2))[0] != combine(word_hashes(b"c x a"), (0, 2))[0]


def test_only_what_lies_on_disk_at_the_peak_is_squeezed_hard():
    """Messages come back whole at either level; those of sweeps, roots and replies take the quick one."""
    rng = np.random.default_rng(3)
    arrays = rng.integers(0, 50, 20_000).astype("<u4"), rng.integers(0, 2**40, 3_000).astype("<u8"), np.empty(0, "<u4")
    quick, hard = hpylm._pack(*arrays), hpylm._pack(*arrays, level=hpylm.HARD)
    assert hpylm.QUICK < hpylm.HARD and quick == hpylm._pack(*arrays, level=hpylm.QUICK)
    for body in (quick, hard):
        assert all((a == b).all() for a, b in zip(arrays, hpylm._unpack(body, "<u4", "<u8", "<u4"), strict=True))


def test_places_are_those_of_np_unique():
    """Small items, items whose leading bits alone can be sorted, and items that differ in their last bits alone."""
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 700, 5000), rng.integers(0, 2**64, 3000, dtype=np.uint64)[rng.integers(0, 3000, 9000)], np.uint64(2**63) + rng.integers(0, 9, 500).astype(np.uint64), np.empty(0, np.uint32), np.zeros(1, "<u4")):
        for a, b in zip(hpylm._ranked(x), np.unique(x, return_inverse=True), strict=True):
            assert (a == b).all() and len(a) == len(b)


def test_triples_are_sent_as_differences():
    """They come back whole in any order of contexts, and take fewer bytes than themselves squeezed hard."""
    rng = np.random.default_rng(5)
    rows = np.unique(np.column_stack([rng.zipf(1.3, 60_000) % 2**20, rng.integers(0, 2**20, 60_000), rng.integers(0, 2**32, 60_000)]), axis=0).astype("<u4")
    for x in (rows, rows[::-1], rows[:1], rows[:0]):
        u2, u1, w = x.T
        cuts = np.flatnonzero(np.append(True, (u2[1:] != u2[:-1]) | (u1[1:] != u1[:-1]))[: len(x)])
        plain = u2[cuts], u1[cuts], np.diff(np.append(cuts, len(x))), w, w & 7
        body = hpylm.pack_triples(u2, u1, w, w & 7)
        assert all(len(a) == len(b) and (a == b).all() for a, b in zip(hpylm.unpack_triples(body), plain, strict=True))
        if x is rows:
            assert len(body) < len(hpylm._pack(*(a.astype("<u4") for a in plain), level=hpylm.HARD))


def test_dishes_of_like_size_are_weighed_together(monkeypatch):
    """Dishes of 9 to 256 customers take few passes, not one for each number of customers."""
    passes, table = [], hpylm._seatings
    monkeypatch.setattr(hpylm, "_seatings", lambda d: passes.append(d) or table(d))
    c = np.arange(9, 257)
    t = hpylm.draw_tables(c, np.full(248, 50.0), np.full(248, 0.01), 0.8, 1.0, np.random.default_rng(6))
    assert (t >= 1).all() and (t <= c).all() and len(passes) < 25
