"""Overview and competition marts. Each is one rollup of the trips, with the sums that panels need kept next to the means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmarts.functions import trip as X
from tripmarts.operators import clean as C
from tripmarts.operators.quantile import hist_mean, hist_quantile, hist_variance
from tripmarts.operators.rollup import count_if, pct, pivot_sum, ratio, rows

# Take rates reported by the two public companies, percent.
REPORTED_TAKE = [("Uber", 25.4), ("Lyft", 33.5)]
FEES = ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "cbd_congestion_fee", "airport_fee"]
UBER_LYFT = ["HV0003", "HV0005"]


def trips(raw: DataFrame) -> DataFrame:
    """Distinct trips with the provider name."""
    return C.drop_exact_duplicates(raw).withColumn("provider", X.provider())


def trips_daily(trips: DataFrame) -> DataFrame:
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{c}_sum") for c in FEES]
    return trips.groupBy(X.day_of("pickup_datetime").alias("date"), X.provider().alias("provider")).agg(
        rows().alias("trips"), F.avg("base_passenger_fare").alias("avg_fare"), F.avg("driver_pay").alias("avg_pay"),
        F.avg("trip_miles").alias("avg_miles"), F.avg("trip_time").alias("avg_time"), F.avg("tips").alias("avg_tips"),
        pct(count_if(F.col("cbd_congestion_fee") > 0), rows()).alias("cbd_fee_pct"),
        pct(F.sum(X.is_shared()), rows()).alias("shared_pct"), pct(count_if(X.flag("wav_match_flag")), rows()).alias("wav_pct"),
        F.sum("driver_pay").alias("pay_sum"), F.sum("trip_miles").alias("miles_sum"), F.sum("trip_time").alias("time_sum"),
        F.sum("tips").alias("tips_sum"), *sums)


def trips_cbd_daily(trips: DataFrame) -> DataFrame:
    return trips_daily(trips.where(F.col("cbd_congestion_fee") > 0))


def trips_hourly_dow_daily(trips: DataFrame) -> DataFrame:
    return trips.groupBy(X.day_of("pickup_datetime").alias("date"), F.hour("pickup_datetime").alias("hour")).agg(rows().alias("trips"))


def trips_hourly_dow(hourly_daily: DataFrame) -> DataFrame:
    """Weekday x hour totals, rolled up from the day x hour mart."""
    return hourly_daily.groupBy(X.dow_sunday0("date").alias("dow"), "hour").agg(F.sum("trips").alias("trips"))


def trips_heatmap(hourly_dow: DataFrame) -> DataFrame:
    """One row per weekday, one column per hour."""
    named = hourly_dow.withColumn("_h", F.concat(F.lit("h"), F.col("hour").cast("string")))
    return pivot_sum(named, ["dow"], "_h", [f"h{h}" for h in range(24)], "trips")


def _zone_economics(trips: DataFrame, zones: DataFrame, period: Column, name: str, zone: str) -> DataFrame:
    """Aggregate by zone id, then join the small dimension."""
    agg = trips.groupBy(period.alias(name), F.col(zone).alias("LocationID")).agg(
        rows().alias("trips"), F.avg("base_passenger_fare").alias("avg_fare"), F.sum("base_passenger_fare").alias("fare_sum"),
        F.sum("driver_pay").alias("pay_sum"), F.sum("trip_time").alias("time_sum"),
        (ratio(F.sum("driver_pay"), F.sum("trip_time")) * 3600).alias("driver_hourly"))
    return agg.join(zones.select("LocationID", "zone", "borough"), "LocationID")


def trips_by_zone(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return _zone_economics(trips, zones, X.month_of("pickup_datetime"), "month", "PULocationID")


def trips_by_zone_daily(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return _zone_economics(trips, zones, X.day_of("pickup_datetime"), "date", "PULocationID")


def trips_by_zone_do(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return _zone_economics(trips, zones, X.month_of("pickup_datetime"), "month", "DOLocationID")


def trips_monthly_provider(trips: DataFrame) -> DataFrame:
    return trips.groupBy(X.month_of("pickup_datetime").alias("month"), X.provider().alias("provider")).agg(
        rows().alias("trips"), F.avg("base_passenger_fare").alias("avg_fare"), F.avg("driver_pay").alias("avg_pay"),
        F.sum(X.gross_bookings()).alias("bookings"), F.sum("base_passenger_fare").alias("fare_sum"), F.sum("driver_pay").alias("pay_sum"),
        ((1 - ratio(F.sum("driver_pay"), F.sum("base_passenger_fare"))) * 100).alias("take_rate_pct"))


def benchmarks(spark: SparkSession, monthly: DataFrame) -> DataFrame:
    """Reported company take rates next to the one measured from the trips."""
    fixed = spark.createDataFrame(REPORTED_TAKE, "entity string, take_rate_pct double")
    measured = monthly.agg(((1 - ratio(F.sum("pay_sum"), F.sum("fare_sum"))) * 100).alias("take_rate_pct"))
    return fixed.unionByName(measured.withColumn("entity", F.lit("NYC")))


def wav_hourly_zone(clean: DataFrame) -> DataFrame:
    """hour x provider x zone counts of inclusive, ordinary accessible-vehicle and ordinary trips."""
    inclusive = X.flag("wav_request_flag") | X.flag("access_a_ride_flag")
    vehicle = X.flag("wav_match_flag")
    return clean.groupBy(F.hour("pickup_datetime").alias("hour"), X.provider().alias("provider"), "PULocationID").agg(
        rows().alias("trips"), count_if(inclusive).alias("inclusive"), count_if(~inclusive & vehicle).alias("ordinary_wav"),
        count_if(~inclusive & ~vehicle).alias("ordinary_regular"))


def wav_wait_fact(clean: DataFrame) -> DataFrame:
    """Row-level waits of trips with a request time, kept with their segment."""
    inclusive = X.flag("wav_request_flag") | X.flag("access_a_ride_flag")
    segment = F.when(inclusive, "inclusive").when(X.flag("wav_match_flag"), "ordinary_wav").otherwise("ordinary_regular")
    return clean.where(F.col("request_datetime").isNotNull()).select(
        X.day_of("pickup_datetime").alias("date"), X.provider().alias("provider"), "PULocationID", segment.alias("segment"),
        X.wait_seconds().alias("wait_sec"))


def mart_shared_zone(clean: DataFrame, zones: DataFrame) -> DataFrame:
    """day x provider x zone shared-ride counts."""
    req, match = F.col("shared_request_flag") == "Y", F.col("shared_match_flag") == "Y"
    agg = clean.where(F.col("hvfhs_license_num").isin(UBER_LYFT)).groupBy(
        X.day_of("pickup_datetime").alias("date"), X.provider_two().alias("provider"), F.col("PULocationID").alias("LocationID")).agg(
        rows().alias("trips"), count_if(req).alias("shared_requests"), count_if(req & match).alias("matched"),
        count_if(req | match).alias("shared_trips"), F.sum("base_passenger_fare").alias("fare_sum"))
    return agg.join(zones.select("LocationID", "zone"), "LocationID")


def mart_segment_daily(clean: DataFrame) -> DataFrame:
    return clean.groupBy(X.day_of("pickup_datetime").alias("date"), X.provider().alias("provider"), X.business_segment().alias("segment")).agg(
        rows().alias("trips"), F.sum(X.gross_bookings()).alias("bookings"), F.sum("base_passenger_fare").alias("fare"),
        F.sum("driver_pay").alias("pay"), F.sum(X.take()).alias("take"))


def wait_hourly_provider(clean: DataFrame) -> DataFrame:
    """hour x weekday x provider x group (citywide, airport): wait statistics from one histogram per cell."""
    timed = clean.where(F.col("request_datetime").isNotNull() & F.col("on_scene_datetime").isNotNull())
    hist = timed.groupBy(F.hour("request_datetime").alias("hour"), X.dow_sunday0("request_datetime").alias("dow"), X.provider().alias("provider"),
                         F.element_at(X.wait_group(), -1).alias("_place"), X.wait_seconds().alias("wait_sec")).agg(rows().alias("n"))
    groups = F.when(F.col("_place") == "citywide", F.array(F.lit("citywide"))).otherwise(F.array(F.lit("citywide"), F.col("_place")))
    long = hist.withColumn("wait_group", F.explode(groups))
    keys = ["hour", "dow", "provider", "wait_group"]
    return long.groupBy(*keys, "wait_sec").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("trips"), hist_mean("wait_sec").alias("avg_wait"), hist_quantile("wait_sec", .5).alias("med_wait"),
        hist_quantile("wait_sec", .9).alias("p90_wait"), hist_variance("wait_sec").alias("var_wait"))


def surge_hourly_provider(clean: DataFrame, low: float = 2, high: float = 5) -> DataFrame:
    """hour x weekday x provider fare per mile of trips in one distance band, Uber and Lyft."""
    band = clean.where(F.col("hvfhs_license_num").isin(UBER_LYFT) & (F.col("trip_miles") >= low) & (F.col("trip_miles") < high))
    fpm = F.col("base_passenger_fare") / F.col("trip_miles")
    return band.groupBy(F.hour("pickup_datetime").alias("hour"), X.dow_sunday0("pickup_datetime").alias("dow"), X.provider_two().alias("provider")).agg(
        rows().alias("trips"), ratio(F.sum("base_passenger_fare"), F.sum("trip_miles")).alias("fare_per_mile"),
        F.avg(fpm).alias("avg_trip_fpm"), F.var_samp(fpm).alias("var_trip_fpm"))


def mile_bin_pricing(clean: DataFrame) -> DataFrame:
    return clean.groupBy(X.provider().alias("provider"), X.mile_bin().alias("mile_bin"), X.mile_bin_order().alias("mile_bin_order")).agg(
        rows().alias("trips"), ((1 - ratio(F.sum("driver_pay"), F.sum("base_passenger_fare"))) * 100).alias("take_rate_pct"),
        ratio(F.sum("base_passenger_fare"), F.sum("trip_miles")).alias("fare_per_mile"))


def clean_trips(trips: DataFrame) -> DataFrame:
    return C.complete_trips(trips)


