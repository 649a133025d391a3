"""Data profiling in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts.functions import trip as X
from tripmarts.operators.quantile import exact_quantiles
from tripmarts.operators.rollup import correlation, count_if


def anomaly_checks() -> dict[str, Column]:
    """Named anomaly conditions of the high-volume family."""
    c = F.col
    mismatch = F.abs(X.seconds_between("pickup_datetime", "dropoff_datetime") - c("trip_time")) > 60
    out = {f"null_{name}": c(field).isNull() for name, field in (
        ("originating_base", "originating_base_num"), ("congestion_surcharge", "congestion_surcharge"), ("airport_fee", "airport_fee"))}
    out.update(trip_miles_le0=c("trip_miles") <= 0, trip_miles_gt100=c("trip_miles") > 100,
               trip_time_le0=c("trip_time") <= 0, trip_time_gt3h=c("trip_time") > 10800,
               dropoff_le_pickup=c("dropoff_datetime") <= c("pickup_datetime"),
               onscene_lt_request=c("on_scene_datetime") < c("request_datetime"),
               pickup_lt_request=c("pickup_datetime") < c("request_datetime"),
               duration_mismatch_gt60s=mismatch, fare_lt0=c("base_passenger_fare") < 0,
               driver_pay_lt0=c("driver_pay") < 0, driver_pay_eq0=c("driver_pay") == 0)
    out.update({f"{side}_zone_out_of_range": ~c(f"{side.upper()}LocationID").between(1, 265) for side in ("pu", "do")})
    out["bad_license_num"] = ~X.known_license()
    return out


def scorecard(df: DataFrame, checks: dict[str, Column], by: dict[str, Column] | None = None) -> DataFrame:
    """Counts of every check per group, all in one aggregate."""
    keys = [c.alias(n) for n, c in (by or {}).items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trips"), *[count_if(c).alias(n) for n, c in checks.items()])


def scorecard_summary(card: DataFrame, checks: list[str]) -> DataFrame:
    """Total and percent of all rows per check, largest first."""
    totals = card.agg(F.sum("n_trips").alias("n_trips"), *[F.sum(c).alias(c) for c in checks])
    long = totals.unpivot([F.col("n_trips")], [F.col(c) for c in checks], "check", "count")
    return (long.withColumn("pct_of_all_trips", F.try_divide(F.col("count") * 100.0, F.col("n_trips").cast("double")))
            .drop("n_trips").orderBy(F.desc("count"), "check"))


def scorecard_percent(card: DataFrame, checks: list[str], month: str) -> DataFrame:
    return card.select(month, *[F.try_divide(F.col(c) * 100.0, F.col("n_trips").cast("double")).alias(f"pct_{c}") for c in checks],
                       (F.month(month) == 11).alias("is_november"))


def discovery(df: DataFrame, checks: dict[str, Column], pickup: str) -> DataFrame:
    """Archive metrics: counts, first and last pickup."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[count_if(c).alias(n) for n, c in checks.items()],
                  F.min(pickup).alias("min_pickup"), F.max(pickup).alias("max_pickup"))


def duplicate_groups(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Number of row values that occur more than once."""
    return (df.groupBy(*(cols or df.columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent of every column."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (wide.unpivot([F.col("_n")], [F.col(c) for c in df.columns], "column", "nulls")
            .select("column", "nulls", F.try_divide(F.col("nulls") * 100.0, F.col("_n").cast("double")).alias("null_pct")))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row per column; quartiles are exact."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], [F.col(c) for c in cols], "column", "value")
    basic = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, ["column"], "value", {"p25": .25, "p50": .5, "p75": .75}), "column")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def clipped_histogram(df: DataFrame, value: str, q: float = 0.99, bins: int = 50, lower: float | None = None) -> DataFrame:
    """Equal-width histogram of all values, those beyond the q-quantile (or below `lower`) counted at the limit."""
    v = df.select(F.lit(1).alias("_k"), F.col(value).cast("double").alias("value")).where("value is not null")
    hi = exact_quantiles(v, ["_k"], "value", {"hi": q}).select("hi").scalar()
    low = F.col("value") if lower is None else F.greatest("value", F.lit(lower))
    kept = v.withColumn("hi", hi).withColumn("value", F.least(low, F.col("hi")))
    lo = kept.agg(F.min("value")).scalar()
    width = (F.col("hi") - lo) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("value") - lo, width)))).cast("int")
    return kept.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def coded_share(df: DataFrame, code: str, labels: dict[int, str]) -> DataFrame:
    """Label a coded column and give each label's share of all rows."""
    table = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    label = F.coalesce(F.try_element_at(table, F.col(code).cast("int")), F.lit("other"))
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("n") / total)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson r of numeric columns, one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    wide = num.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("p")).select("p.a", "p.b", "p.r")


def mart_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Violations of each row check, one pass; 0 means the check holds."""
    wide = df.agg(*[count_if(~c).alias(n) for n, c in checks.items()])
    return wide.unpivot([], [F.col(n) for n in checks], "check", "violations")


def missing_dates(df: DataFrame, date: str) -> DataFrame:
    """Days between the first and the last date that have no row."""
    days = df.select(F.col(date).alias("date")).distinct()
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).join(days, "date", "left_anti")


