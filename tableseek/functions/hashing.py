"""Seeded hash order: the same choice on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: str | Column, seed: int | str = 42) -> Column:
    """md5 over the seed and the (integer or string) parts; ascending order = random order."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(*parts: str | Column, seed: int | str = 42) -> Column:
    """Non-negative 60-bit integer drawn from the same hash."""
    return F.conv(F.substring(hash_key(*parts, seed=seed), 1, 15), 16, 10).cast("bigint")


def hash_mod(modulus: Column | int, *parts: str | Column, seed: int | str = 42) -> Column:
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.pmod(hash_number(*parts, seed=seed), m)
