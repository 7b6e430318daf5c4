"""A seeded hash in integer arithmetic alone, so that samples and shuffles come out alike in any SQL engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lcg(x: Column) -> Column:
    return (x * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)


def portable_hash(v: Column, seed: int) -> Column:
    """0 <= value < 2**31, for v >= 0."""
    v = v.cast("long")
    return _lcg(F.floor(_lcg(v + F.lit(seed)) / F.lit(7)).cast("long") + v)


def portable_hash_sql(v: str, seed: int) -> str:
    g = lambda x: f"((({x}) * 1103515245 + 12345) % 2147483648)"
    return g(f"({g(f'({v})::BIGINT + {seed}')} // 7) + ({v})::BIGINT")


def rounded(c: Column, digits: int = 6) -> Column:
    """c to so many digits; -0.0 becomes 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def portable_hash_numpy(v: np.ndarray, seed: int) -> np.ndarray:
    """portable_hash of an array of integers from 0 to 2**32."""
    g = lambda x: (x * 1103515245 + 12345) % 2147483648
    v = v.astype(np.int64)
    return g(g(v + seed) // 7 + v)
