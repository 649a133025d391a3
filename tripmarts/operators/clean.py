"""Cleaning rules, validation and removal reports of the four trip families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators.rollup import count_if

# The accepted years and the limits of a high-volume trip.
YEARS = (2019, 2026)
MAX_MILES, MAX_SECONDS = 100, 10800
# Money columns of a metered trip that must be present and non-negative, or non-negative when present.
METERED_REQUIRED = ["fare_amount", "mta_tax", "tip_amount", "tolls_amount", "total_amount"]
METERED_OPTIONAL = ["extra", "improvement_surcharge", "congestion_surcharge"]


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def year_range(ts: str, years: tuple[int, int]) -> Column:
    """Years as a range on the timestamp, so that the scan can prune."""
    lo, hi = years
    return (F.col(ts) >= F.lit(f"{lo}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{hi + 1}-01-01").cast("timestamp_ntz"))


def metered_rules(pickup: str, dropoff: str, years=YEARS) -> dict[str, Column]:
    rules = {f"{c}_nonneg": F.col(c) >= 0 for c in METERED_REQUIRED}
    rules["distance_positive"] = F.col("trip_distance") > 0
    rules.update({f"{c}_nonneg_or_null": F.col(c).isNull() | (F.col(c) >= 0) for c in METERED_OPTIONAL})
    rules["year_in_range"] = year_range(pickup, years)
    rules["dropoff_after_pickup"] = F.col(dropoff) > F.col(pickup)
    return rules


def rules(family: str, years=YEARS) -> dict[str, Column]:
    """Named rules of a family; a row is kept when every rule is true."""
    if family == "yellow":
        return metered_rules("tpep_pickup_datetime", "tpep_dropoff_datetime", years)
    if family == "green":
        return metered_rules("lpep_pickup_datetime", "lpep_dropoff_datetime", years)
    if family == "fhv":
        zone_ok = {f"{c}_known": F.col(c).isNotNull() & (F.col(c) != 0) for c in ("PUlocationID", "DOlocationID")}
        return {**zone_ok, "base_known": F.col("dispatching_base_num").isNotNull(),
                "dropoff_after_pickup": F.col("dropOff_datetime") > F.col("pickup_datetime")}
    if family == "fhvhv":
        return {"miles_in_range": (F.col("trip_miles") > 0) & (F.col("trip_miles") <= MAX_MILES),
                "time_in_range": (F.col("trip_time") > 0) & (F.col("trip_time") <= MAX_SECONDS),
                "fare_nonneg": F.col("base_passenger_fare") >= 0, "pay_nonneg": F.col("driver_pay") >= 0,
                "dropoff_after_pickup": F.col("dropoff_datetime") > F.col("pickup_datetime")}
    raise ValueError(f"unknown family {family}")


def predicate(family: str, years=YEARS) -> Column:
    return _all(list(rules(family, years).values()))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Equal rows once: one shuffle of the rows whatever their number; copies that meet in a map task are combined before it."""
    return df.distinct()


def clean(df: DataFrame, family: str, scope: str | None = None, years=YEARS) -> DataFrame:
    """Keep valid rows once. With `scope` (a source-file column) duplicates are dropped per file."""
    kept = df.where(predicate(family, years))
    if scope is not None and scope not in df.columns:
        kept = kept.withColumn(scope, F.col("_metadata.file_path"))
    return drop_exact_duplicates(kept)


def rule_violations(df: DataFrame, family: str, years=YEARS) -> DataFrame:
    """Rows failing each rule and rows where the rule is unknown, one pass."""
    named = rules(family, years)
    wide = df.agg(*[F.struct(count_if(~c).alias("violations"), count_if(c.isNull()).alias("unknown")).alias(n)
                    for n, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("c")) for n in named])
    return wide.select(F.explode(pairs).alias("p")).select("p.rule", "p.c.violations", "p.c.unknown")


def validate(df: DataFrame, family: str, by: list[str] | None = None, years=YEARS) -> DataFrame:
    """Rows where NOT(rules) is true; rows where it is unknown are listed apart."""
    bad = ~predicate(family, years)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), count_if(bad).alias("violations"),
                                       count_if(bad.isNull()).alias("unknown"))


def removal_report(raw: DataFrame, cleaned: DataFrame, by: list[str]) -> DataFrame:
    """Rows before and after cleaning per source, with the removed part in percent."""
    before = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_rows"))
    after = cleaned.groupBy(*by).agg(F.count(F.lit(1)).alias("clean_rows"))
    both = before.join(after, by, "full").fillna(0, ["raw_rows", "clean_rows"])
    removed = F.col("raw_rows") - F.col("clean_rows")
    return both.withColumns({"removed": removed, "removed_pct": F.try_divide(removed * 100.0, F.col("raw_rows").cast("double"))})


def row_hashes(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row; nulls count at their place."""
    values = [F.col(f"`{c}`") for c in columns]
    empty = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [F.xxhash64(empty, *values).alias("_h1"), F.xxhash64(*reversed(values), F.lit(7), empty).alias("_h2")]


def counted_report(raw: DataFrame, valid: Column, by: list[str]) -> DataFrame:
    """Rows before and after cleaning per source in one pass: hashes of rows are shuffled, not rows."""
    columns = [c for c in raw.columns if c not in by]
    hashes = row_hashes(columns)
    kept = [F.when(F.coalesce(valid, F.lit(False)), h).alias(n) for h, n in zip(hashes, ("_h1", "_h2"), strict=True)]
    groups = raw.select(*by, *kept).groupBy(*by, "_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    out = groups.groupBy(*by).agg(F.sum("n").alias("raw_rows"), F.count("_h1").alias("clean_rows"))
    removed = F.col("raw_rows") - F.col("clean_rows")
    return out.withColumns({"removed": removed, "removed_pct": F.try_divide(removed * 100.0, F.col("raw_rows").cast("double"))})


def report_rollup(report: DataFrame, by: list[str]) -> DataFrame:
    out = report.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("raw_rows", "clean_rows", "removed")])
    return out.withColumn("removed_pct", F.try_divide(F.col("removed") * 100.0, F.col("raw_rows").cast("double")))


def pending(raw_sources: DataFrame, clean_sources: DataFrame, key: str) -> DataFrame:
    """Raw sources that have no clean twin yet."""
    return raw_sources.select(key).distinct().join(clean_sources.select(key).distinct(), key, "left_anti")


def failing_sources(report: DataFrame) -> DataFrame:
    """Sources to clean again: those with violations left."""
    return report.where(F.col("violations") > 0)


def request_before_pickup(df: DataFrame) -> DataFrame:
    return df.where(F.col("request_datetime") < F.col("pickup_datetime"))


def complete_trips(df: DataFrame) -> DataFrame:
    """Overview filter: keys present, positive time, non-negative fare and miles, drop-off not before pick-up."""
    present = _all([F.col(c).isNotNull() for c in ("PULocationID", "DOLocationID", "pickup_datetime", "dropoff_datetime")])
    return df.where(present & (F.col("trip_time") > 0) & (F.col("base_passenger_fare") >= 0) & (F.col("trip_miles") >= 0)
                    & (F.col("dropoff_datetime") >= F.col("pickup_datetime")))


def wait_trips(df: DataFrame) -> DataFrame:
    """Trips of a known provider that waited more than zero seconds and less than an hour."""
    return (df.where((F.col("pickup_datetime") > F.col("request_datetime")) & F.col("PULocationID").isNotNull() & X.known_license())
            .select(F.col("PULocationID").alias("zone"), X.provider().alias("aggregator"), F.hour("request_datetime").alias("hr"),
                    X.dow_monday0("request_datetime").alias("dow"), X.wait_seconds().alias("wait_sec"))
            .where(F.col("wait_sec") < 3600)
            .withColumn("period", X.day_period("hr")))


# Columns whose presence and sign make the economics of a trip usable.
ECONOMIC_FIELDS = ["base_passenger_fare", "driver_pay", "tips", "tolls", "bcf", "sales_tax", "congestion_surcharge",
                   "airport_fee", "cbd_congestion_fee"]


def enrich(df: DataFrame) -> DataFrame:
    """Accessibility view: flags, waits (seconds) and five validity booleans; no row is dropped."""
    base = df.withColumns({
        "provider": X.provider_two(), "pickup_date": X.day_of("pickup_datetime"), "pickup_month": X.month_of("pickup_datetime"),
        "dow": X.dow_sunday0("pickup_datetime"), "pickup_hour": F.hour("pickup_datetime"),
        "request_to_pickup_sec": X.wait_seconds(),
        "arrival_offset_sec": X.seconds_between("request_datetime", "on_scene_datetime"),
        "boarding_sec": X.seconds_between("on_scene_datetime", "pickup_datetime"),
        "timestamp_trip_sec": X.seconds_between("pickup_datetime", "dropoff_datetime"),
        "speed_mph": X.speed_mph(),
        "is_wav_request": X.flag("wav_request_flag"), "is_wav_trip": X.flag("wav_match_flag"), "is_aar": X.flag("access_a_ride_flag")})
    core = _all([F.col("dropoff_datetime") >= F.col("pickup_datetime"), F.col("trip_time") > 0, F.col("trip_miles") >= 0,
                 F.col("speed_mph") <= 100, F.col("PULocationID") > 0, F.col("DOLocationID") > 0])
    return base.withColumns({
        "core_valid": F.coalesce(core, F.lit(False)), "wait_valid": X.wait_is_valid(), "arrival_wait_valid": X.arrival_valid(),
        "boarding_valid": X.boarding_is_valid(),
        "economics_valid": F.coalesce(_all([F.col(c) >= 0 for c in ECONOMIC_FIELDS]), F.lit(False))})


def access_trips(df: DataFrame) -> DataFrame:
    """Core-valid trips of the two large providers."""
    return enrich(df.where(F.col("hvfhs_license_num").isin("HV0003", "HV0005"))).where("core_valid")
