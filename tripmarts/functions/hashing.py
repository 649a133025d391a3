"""Deterministic draws: the same key gives the same number on every partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2 ** 32


def draw(*parts) -> Column:
    """Integer in [0, 2^32) from the md5 of the dash-joined parts."""
    key = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    return draw(*parts) / F.lit(float(DRAW_RANGE))


def draw_index(n, *parts) -> Column:
    """Integer in [0, n)."""
    return draw(*parts) % n
