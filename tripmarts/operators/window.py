"""Analytic operators on marts (one row per grain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage


def share(df: DataFrame, value: str, within: list[str] | None = None, name: str = "share_pct", scale: float = 100.0) -> DataFrame:
    """Percent of the group total, or of the grand total when `within` is empty."""
    if within:
        total = F.sum(value).over(Window.partitionBy(*within))
    else:
        total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.try_divide(F.lit(scale) * F.col(value), total.cast("double")))


def index_to_base(df: DataFrame, value: str, series: list[str], is_base: Column, name: str = "index_base_100",
                  fallback: str | None = None) -> DataFrame:
    """100 * value / base value of the series. A missing base gives NULL, or 100 with fallback='self'."""
    base = F.max(F.when(is_base, F.col(value))).over(Window.partitionBy(*series))
    if fallback == "self":
        base = F.coalesce(base, F.col(value))
    return df.withColumn(name, F.try_divide(F.lit(100.0) * F.col(value), base.cast("double")))


def yoy(df: DataFrame, value: str, keys: list[str], year: str, name: str = "yoy_pct") -> DataFrame:
    """Percent change against the previous row of the series by year."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(year))
    return df.withColumn(name, (F.try_divide(F.col(value).cast("double"), prev.cast("double")) - 1) * 100)


def year_before(df: DataFrame, keys: list[str], month: str, values: list[str]) -> DataFrame:
    """Each month next to the same month a year earlier (NULL when absent)."""
    earlier = df.select(*keys, F.add_months(month, 12).alias(month), *[F.col(v).alias(f"{v}_prev") for v in values])
    return df.join(earlier, [*keys, month], "left")


def trailing_mean(value: str, keys: list[str], order: str, n: int) -> Column:
    """Mean of the n rows before the current one; NULL until n rows exist."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w))


def rolling_mean(value: str, keys: list[str], order: str, n: int) -> Column:
    """Mean of the last n rows including the current one; NULL until n non-null values exist."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def demean(df: DataFrame, cols: list[str], by: list[list[str]], suffix: str = "_dm") -> DataFrame:
    """Subtract group means, one grouping after the other (order matters on unbalanced panels)."""
    out = df.select("*", *[F.col(c).cast("double").alias(c + suffix) for c in cols])
    for keys in by:
        w = Window.partitionBy(*keys)
        out = out.withColumns({c + suffix: F.col(c + suffix) - F.avg(c + suffix).over(w) for c in cols})
    return out


def add_group_mean(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Left join of a conditional group mean; the mean is combined before the shuffle, the rows stay put
    when the aggregate is small enough for Spark to broadcast it."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(name))
    return df.join(means, keys, "left")


def _ordered(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """The rows in global order, written once: `_part` is the number of the task that held a row, `_inner` its place there from 1.
    Range borders fall between rows, not between values, so a value that a third of the rows share is spread over tasks as far as `by` tells its rows apart."""
    at = F.monotonically_increasing_id()
    placed = lineage.cut(df.orderBy(*by).withColumn("_at", at))
    return placed.withColumns({"_part": F.shiftright("_at", 33), "_inner": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_at")


def _offsets(placed: DataFrame) -> DataFrame:
    """Rows in all earlier parts; one row per task that sorted, so the window is small."""
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    return sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))


def global_rank(df: DataFrame, value: str, tie: list[str], name: str = "rank") -> DataFrame:
    """Row number 1..N over the whole table by (value, tie), nulls first: place inside the sorted part plus the rows before it."""
    placed = _ordered(df, [value, *tie])
    return placed.join(F.broadcast(_offsets(placed)), "_part").withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Mid-rank of each value over the whole table (ties share the mean of their ranks); rows without a value go.

    Rows of one value may lie in several parts. The first and last place of a run are found inside each part; only runs at the borders of parts
    (at most two a part) are closed over them, by a table that has fewer rows than there are parts. No value is a key of a shuffle by itself.
    """
    placed = _ordered(df.where(F.col(value).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), [value, "_row"])
    ranked = placed.join(F.broadcast(_offsets(placed)), "_part").withColumn("_at", F.col("_before") + F.col("_inner"))
    runs = ranked.groupBy("_part", value).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    crossing = runs.groupBy(F.col(value).alias("_value")).agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    inside = runs.select(F.col("_part").alias("_run_part"), F.col(value).alias("_run_value"), "_low", "_high")
    met = ranked.join(inside, (F.col("_part") == F.col("_run_part")) & (F.col(value) == F.col("_run_value"))).join(F.broadcast(crossing), F.col(value) == F.col("_value"), "left")
    mid = (F.coalesce("_first", "_low") + F.coalesce("_last", "_high")) / F.lit(2.0)
    return met.select(*df.columns, mid.alias(name))


def rank_bins(df: DataFrame, value: str, n: int, tie: list[str], name: str = "bin") -> DataFrame:
    """Equal-count bins of the rank, ties broken by `tie`; bin edges are linear in the rank 1..N and the
    first bin includes its left edge, as quantile cuts do."""
    total = df.agg(F.count(F.lit(1))).scalar()
    pos = (F.col("_rn") - 1) * n / F.greatest(F.col("_n") - 1, F.lit(1))
    return (global_rank(df, value, tie, "_rn").withColumn("_n", total)
            .withColumn(name, F.greatest(F.lit(1), F.ceil(pos)).cast("int")).drop("_rn", "_n"))


def order_tiers(df: DataFrame, value: str, tie: list[str], labels: list[str], name: str = "tier") -> DataFrame:
    """Tiers cut at the order statistics n/k, 2n/k, ... (0-based positions) of the value."""
    ranked = global_rank(df.select(value, *tie), value, tie, "_rn")
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = ranked.withColumn("_n", total)
    k = len(labels)
    cuts = ranked.agg(*[F.max(F.when(F.col("_rn") - 1 == F.floor(F.col("_n") * i / k), F.col(value))).alias(f"c{i}") for i in range(1, k)])
    out, cond = df, None
    for i, label in enumerate(labels[:-1], start=1):
        out = out.withColumn(f"_c{i}", cuts.select(f"c{i}").scalar())
        test = F.col(value) <= F.col(f"_c{i}")
        cond = F.when(test, label) if cond is None else cond.when(test, label)
    return out.withColumn(name, cond.otherwise(labels[-1])).drop(*[f"_c{i}" for i in range(1, k)])


def threshold_tiers(df: DataFrame, value: str, labels: list[str], name: str = "tier") -> DataFrame:
    """Tiers cut at interpolated quantiles k/len(labels)."""
    out, n = None, len(labels)
    for i, label in enumerate(labels[:-1], start=1):
        cut = df.agg(F.percentile(value, F.lit(i / n))).scalar()
        cond = F.col(value) <= cut
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return df.withColumn(name, out.otherwise(labels[-1]))
