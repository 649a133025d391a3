"""Joins of facts, marts and dimensions. No hints: dimensions come with a size, and Spark broadcasts by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_zone(df: DataFrame, zones: DataFrame, key: str, how: str = "inner", suffix: str = "") -> DataFrame:
    """Borough and zone name of a zone id; 'left' keeps ids that are not in the dimension."""
    z = zones.select(F.col("LocationID").alias(key), F.col("borough").alias(f"borough{suffix}"), F.col("zone").alias(f"zone{suffix}"))
    return df.join(z, key, how)


def star(base: DataFrame, key: str, parts: list[DataFrame], how: str = "left") -> DataFrame:
    """One row of `base` with the columns of several marts of the same grain."""
    for p in parts:
        base = base.join(p, key, how)
    return base


def inside(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(keys, on, "left_semi")


def outside(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows whose key is not in the other table."""
    return df.join(keys, on, "left_anti")


def outer_fill(a: DataFrame, b: DataFrame, on: list[str], fill: float = 0) -> DataFrame:
    """Full outer join with one key and missing measures filled."""
    measures = [c for c in [*a.columns, *b.columns] if c not in on]
    return a.join(b, on, "full").fillna(fill, measures)
