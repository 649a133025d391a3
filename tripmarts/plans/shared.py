"""Shared-ride marts. Input: trips whose request precedes the pickup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmarts.functions import trip as X
from tripmarts.operators.rollup import count_if, pct, ratio

UBER_LYFT = ["HV0003", "HV0005"]


def _pair(req: str, match: str) -> Column:
    return F.coalesce((F.col("shared_request_flag") == req) & (F.col("shared_match_flag") == match), F.lit(False))


def _matched() -> Column:
    return _pair("Y", "Y")


def _any_shared() -> Column:
    return F.coalesce((F.col("shared_request_flag") == "Y") | (F.col("shared_match_flag") == "Y"), F.lit(False))


def _two_providers(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("hvfhs_license_num").isin(UBER_LYFT)).withColumn("provider", X.provider_two())


def mart_shared_daily(clean: DataFrame) -> DataFrame:
    """Day x provider shared-ride measures.

    Two matched requests share one ride, so a matched row counts one half. A matched row's fare is raised by
    the day's mean shared fare; since that mean is constant within the grain, the corrected mean follows from
    sums of one aggregate and needs no join back to the trips.
    """
    yy, nn, single = _matched(), _pair("N", "N"), _pair("Y", "N") | _pair("N", "Y")
    shared, combo = _any_shared(), yy | single
    fare, pay = F.col("base_passenger_fare"), F.col("driver_pay")
    base = _two_providers(clean).select(
        X.day_of("pickup_datetime").alias("date"), "provider", "trip_time", "trip_miles", "base_passenger_fare", "driver_pay",
        "shared_request_flag", "shared_match_flag")
    margin = fare - pay
    sums = base.groupBy("date", "provider").agg(
        F.count(F.lit(1)).alias("n"), count_if(yy).alias("yy"), count_if(shared).alias("using"),
        count_if(single).alias("single"),
        (F.avg(F.when(nn, F.col("trip_time"))) / 60).alias("avg_duration_non_shared"),
        (F.avg(F.when(yy, F.col("trip_time"))) / 60).alias("avg_duration_shared"),
        F.avg(F.when(nn, F.col("trip_miles"))).alias("avg_distance_non_shared"),
        F.avg(F.when(yy, F.col("trip_miles"))).alias("avg_distance_shared"),
        F.avg(F.when(shared, fare)).alias("avg_shared_fare"),
        F.sum(F.when(combo, fare)).alias("fare_sum"), F.count(F.when(combo, fare)).alias("fare_n"),
        F.count(F.when(yy, fare)).alias("fare_yy"),
        F.avg(F.when(nn, fare)).alias("base_fare_non_shared"),
        F.avg(F.when(nn, pay)).alias("driver_pay_non_shared"), F.avg(F.when(shared, pay)).alias("driver_pay_shared"),
        F.avg(F.when(nn, margin)).alias("contribution_non_shared"),
        F.sum(F.when(combo, margin)).alias("margin_sum"), F.count(F.when(combo, margin)).alias("margin_n"),
        F.count(F.when(yy, margin)).alias("margin_yy"))
    trips = F.col("n") - F.floor(F.col("yy") / 2)
    sharing = F.col("single") + F.col("yy") * 0.5
    lift = F.coalesce(F.col("avg_shared_fare"), F.lit(0.0))
    return sums.select(
        "date", F.date_format("date", "EEEE").alias("week_day"), "provider", F.col("n").alias("total_amount_using"),
        trips.alias("total_amount_trips"), F.col("using").alias("shering_amount_using"), sharing.alias("shering_amount_trips"),
        "avg_duration_non_shared", "avg_duration_shared", "avg_distance_non_shared", "avg_distance_shared",
        F.try_divide(F.col("fare_sum") + F.col("fare_yy") * lift, F.col("fare_n")).alias("base_fare_shared"),
        "base_fare_non_shared", "driver_pay_non_shared", "driver_pay_shared", "contribution_non_shared",
        F.try_divide(F.col("margin_sum") + F.col("margin_yy") * lift, F.col("margin_n")).alias("contribution_shared"),
        F.try_divide(sharing * 100.0, trips.cast("double")).alias("match_rate"))


def flag_combinations(trips: DataFrame) -> DataFrame:
    return (trips.groupBy(X.provider().alias("provider"), "shared_request_flag", "shared_match_flag")
            .agg(F.count(F.lit(1)).alias("trips")))


def overview_totals(clean: DataFrame) -> DataFrame:
    return clean.agg(F.count(F.lit(1)).alias("trips"), count_if(_any_shared()).alias("shared_trips")).withColumn(
        "shared_pct", F.try_divide(F.col("shared_trips") * 100.0, F.col("trips").cast("double")))


def zone_match(clean: DataFrame, zones: DataFrame, min_trips: int = 100) -> DataFrame:
    """Provider x zone match rate (both flags set, over requests); aggregated before the names are joined."""
    per_zone = _two_providers(clean).groupBy("provider", "PULocationID").agg(
        F.count(F.lit(1)).alias("trips"), count_if(_matched()).alias("matched_shared_requests"),
        count_if(F.col("shared_request_flag") == "Y").alias("shared_requests"))
    named = per_zone.join(zones.select(F.col("LocationID").alias("PULocationID"), "zone"), "PULocationID")
    out = named.groupBy("provider", "zone").agg(*[F.sum(c).alias(c) for c in ("trips", "matched_shared_requests", "shared_requests")])
    return (out.where(F.col("trips") >= min_trips)
            .withColumn("match_rate_pct", F.try_divide(F.col("matched_shared_requests") * 100.0, F.col("shared_requests").cast("double")))
            .orderBy("provider", F.desc_nulls_last("match_rate_pct"), "zone"))


def shared_heatmap(clean: DataFrame) -> DataFrame:
    """Provider x weekday x hour request share, weekdays in calendar order."""
    requested = F.col("shared_request_flag") == "Y"
    out = _two_providers(clean).groupBy(
        "provider", X.dow_monday0("pickup_datetime").alias("_dow"), X.weekday_name("pickup_datetime").alias("week_day"),
        F.hour("pickup_datetime").alias("hour")).agg(
        F.count(F.lit(1)).alias("total_trips"), count_if(requested).alias("shared_requests"),
        pct(count_if(requested), F.count(F.lit(1))).alias("shared_request_pct"))
    return out.orderBy("provider", "_dow", "hour").drop("_dow")


def _shared_by(clean: DataFrame, key: Column, name: str) -> DataFrame:
    return clean.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("total_trips"), count_if(_any_shared()).alias("shared_trips"),
        ratio(count_if(_any_shared()), F.count(F.lit(1))).alias("shared_share")).orderBy(name)


def by_duration(clean: DataFrame) -> DataFrame:
    return _shared_by(clean, X.duration_bucket(), "duration_group")


def by_hour(clean: DataFrame) -> DataFrame:
    return _shared_by(clean, F.hour("request_datetime"), "hour")


def by_peak(clean: DataFrame) -> DataFrame:
    peak = X.shared_peak(X.dow_sunday0("request_datetime"), F.hour("request_datetime"))
    return _shared_by(clean, F.when(peak, "Peak").otherwise("Non-peak"), "is_peak")


def zone_summary(clean: DataFrame, zones: DataFrame, license_num: str = "HV0003", min_requests: int = 100) -> DataFrame:
    """One provider's zones: trips, requests, matches and matches per request."""
    per_zone = clean.where(F.col("hvfhs_license_num") == license_num).groupBy("PULocationID").agg(
        F.count(F.lit(1)).alias("total_trips"), count_if(F.col("shared_request_flag") == "Y").alias("shared_requests"),
        count_if(F.col("shared_match_flag") == "Y").alias("matched_trips")).where(F.col("shared_requests") >= min_requests)
    return (per_zone.join(zones.select(F.col("LocationID").alias("PULocationID"), "borough", "zone"), "PULocationID")
            .withColumn("match_rate", F.try_divide(F.col("matched_trips") * 100.0, F.col("shared_requests").cast("double")))
            .orderBy(F.desc("total_trips"), "PULocationID"))
