"""Deterministic draws: every random choice is an order by a keyed hash.

The result depends on the seed and the row's own key only, never on the
partitioning, so a re-run, a lost executor or another engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(seed: int | str, *cols: str | Column) -> Column:
    """Hex md5 of ``seed:col1:col2...``; order by it to shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def hash_uint(seed: int | str, *cols: str | Column) -> Column:
    """The first 8 hex digits of the keyed hash as a BIGINT in [0, 2^32)."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 8), 16, 10).cast("bigint")


def hash_draw(seed: int | str, n: int | Column, *cols: str | Column) -> Column:
    """An integer in [0, n) drawn by the keyed hash."""
    n = F.lit(n) if isinstance(n, int) else n
    return hash_uint(seed, *cols) % n
