"""Rollups: grouping sets, pivots, ratios of sums, dominance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows() -> Column:
    """COUNT(*)."""
    return F.count(F.lit(1))


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_if(cond: Column, value) -> Column:
    return F.sum(F.when(cond, value))


def avg_if(cond: Column, value) -> Column:
    return F.avg(F.when(cond, value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of two aggregates, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def correlation(x, y) -> Column:
    """Pearson r over rows where both are present; NULL when either side is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def rollup_sets(df: DataFrame, keys: list[str], sets: list[list[str]], measures: list[Column],
                all_label: dict[str, str] | None = None) -> DataFrame:
    """GROUPING SETS in one pass; a key aggregated away shows its label (NULL when it has none)."""
    labels = all_label or {}
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    agg = grouped.agg(*measures, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    for k in keys:
        if k in labels:
            agg = agg.withColumn(k, F.when(F.col(f"_g_{k}") == 1, F.lit(labels[k])).otherwise(F.col(k)))
    return agg.drop(*[f"_g_{k}" for k in keys])


def pivot_sum(df: DataFrame, keys: list[str], column: str, values: list, measure: str, fill=0) -> DataFrame:
    """Long to wide with declared values: one conditional aggregate per value, no discovery job."""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col(column) == v, F.col(measure))), F.lit(fill)).alias(str(v)) for v in values])


def dominant(long: DataFrame, key: str, category: str, order: list[str], measure: str = "trips") -> DataFrame:
    """Category with the largest measure per key; ties go to the earlier name in `order`."""
    wide = pivot_sum(long, [key], category, order, measure)
    total = F.col(order[0])
    for c in order[1:]:
        total = total + F.col(c)
    best = F.greatest(*[F.col(c) for c in order])
    name = None
    for c in order:
        name = F.when(F.col(c) == best, c) if name is None else name.when(F.col(c) == best, c)
    return (wide.withColumn("total", total).where(F.col("total") > 0)
            .withColumn("dominant", name).withColumn("dominant_share_pct", ratio(best, F.col("total")) * 100))


def top_n(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Top n rows overall (ordered limit) or per group (rank filter, pre-trimmed per task by Spark)."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(v) for v in values], name, value)
