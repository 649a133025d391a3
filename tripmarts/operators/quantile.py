"""Exact and approximate grouped quantiles that survive a group holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage


def value_histogram(df: DataFrame, keys: list, value, n: str = "n") -> DataFrame:
    """(keys, value, count): combined on the map side, so a hot key costs one row per distinct value and task."""
    v = F.col(value) if isinstance(value, str) else value
    name = value if isinstance(value, str) else "value"
    return df.where(v.isNotNull()).groupBy(*keys, v.alias(name)).agg(F.count(F.lit(1)).alias(n))


def hist_quantile(value: str, q: float, n: str = "n") -> Column:
    """Interpolated exact quantile of a value histogram; state is one entry per distinct value."""
    return F.percentile(F.col(value), F.lit(q), F.col(n))


def hist_mean(value: str, n: str = "n") -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(n)).cast("double"), F.sum(n))


def hist_variance(value: str, n: str = "n") -> Column:
    """Sample variance from sums over a histogram."""
    s0, s1 = F.sum(n).cast("double"), F.sum(F.col(value) * F.col(n)).cast("double")
    s2 = F.sum(F.col(value) * F.col(value) * F.col(n)).cast("double")
    return F.when(F.sum(n) > 1, (s2 - s1 * s1 / s0) / (s0 - 1))


def approx_quantile(value, q: float, accuracy: int = 10000) -> Column:
    return F.percentile_approx(value, F.lit(q), F.lit(accuracy))


def bin_quantile(hist: DataFrame, keys: list[str], value: str, n: str, probs: dict[str, float]) -> DataFrame:
    """Weighted quantile of a binned histogram: first bin whose cumulative count reaches q*N (no interpolation)."""
    w = Window.partitionBy(*keys)
    cum = F.sum(n).over(w.orderBy(value))
    h = hist.withColumn("_cum", cum).withColumn("_total", F.sum(n).over(w))
    return h.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        *[F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_total"), F.col(value))).alias(name) for name, q in probs.items()])


#: Groups whose cut points are broadcast; with more groups the rows are joined to them by a shuffle.
BROADCAST_GROUPS = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Exact interpolated quantiles of a continuous value, in two passes and without a shuffle of all values.

    The first pass sketches, per group, a narrow interval of values around each target. The second counts: inside
    the intervals by value, between them only rows, least and largest value, all combined before the shuffle. A
    sketch is off by at most 1/accuracy of the rows and an interval reaches 2/accuracy to both sides, so the target
    order statistics lie inside, or, in small groups, right beside an interval; anything else is an error.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull())
    margin = 2.0 / accuracy
    ends = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probs.values()]
    sketched = rows.groupBy(*keys).agg(F.percentile_approx(v, F.array(*[F.lit(e) for pair in ends for e in pair]), F.lit(accuracy)).alias("_cuts"))
    cuts = lineage.cut(sketched)
    if cuts.count() <= BROADCAST_GROUPS:
        cuts = F.broadcast(cuts)
    low_cut = [F.col("_cuts")[2 * i] for i in range(len(ends))]
    high_cut = [F.col("_cuts")[2 * i + 1] for i in range(len(ends))]
    inside, part = F.lit(False), F.lit(0)
    for lo, hi in zip(low_cut, high_cut, strict=True):
        inside = inside | ((v >= lo) & (v <= hi))
        part = part + (v >= lo).cast("int") + (v > hi).cast("int")
    placed = rows.join(cuts, keys).select(*keys, v.alias("_v"), part.alias("_part"), F.when(inside, v).alias("_exact"))
    counted = placed.groupBy(*keys, "_part", "_exact").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    by_key = Window.partitionBy(*keys)
    ranked = (counted.withColumn("_hi", F.sum("_n").over(by_key.orderBy("_part", "_min")))
              .withColumn("_total", F.sum("_n").over(by_key)).withColumn("_lo", F.col("_hi") - F.col("_n")))

    def at(position: Column) -> Column:
        here = (F.when(F.col("_exact").isNotNull() | (position == F.col("_lo")), F.col("_min"))
                .when(position == F.col("_hi") - 1, F.col("_max")).otherwise(F.raise_error(F.lit("quantile outside its interval"))))
        return F.max(F.when((F.col("_lo") <= position) & (position < F.col("_hi")), here))

    picks = []
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("_total") - 1)
        low = F.floor(pos)
        high = F.least(low + 1, F.col("_total") - 1)
        at_low, at_high = at(low), at(high)
        picks.append((at_low + (at_high - at_low) * F.max(pos - low)).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
