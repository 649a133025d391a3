"""Overview and competition marts."""

from catalog.base import T, cte, register
from catalog.steps import PROVIDER2, PROVIDER4
from tripmarts.operators import clean as C
from tripmarts.plans import overview as O

F_ = "fhvhv_trips"


def trips(spark, d):
    return T(F_)(spark, d)


def clean(spark, d):
    return C.complete_trips(trips(spark, d))


FEES = ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "cbd_congestion_fee", "airport_fee"]
DAILY_SPEC = ("date:date provider:str trips avg_fare:real avg_pay:real avg_miles:real avg_time:real avg_tips:real cbd_fee_pct:real shared_pct:real wav_pct:real "
              "pay_sum:real miles_sum:real time_sum tips_sum:real " + " ".join(f"{c}_sum:real" for c in FEES))
DAILY = f"""SELECT CAST(pickup_datetime AS DATE) AS date, {PROVIDER4} AS provider, count(*) AS trips, avg(base_passenger_fare) AS avg_fare, avg(driver_pay) AS avg_pay,
  avg(trip_miles) AS avg_miles, avg(trip_time) AS avg_time, avg(tips) AS avg_tips, 100.0 * count(*) FILTER (WHERE cbd_congestion_fee > 0) / count(*) AS cbd_fee_pct,
  100.0 * count(*) FILTER (WHERE shared_request_flag = 'Y' OR shared_match_flag = 'Y') / count(*) AS shared_pct,
  100.0 * count(*) FILTER (WHERE wav_match_flag = 'Y') / count(*) AS wav_pct, sum(driver_pay) AS pay_sum, sum(trip_miles) AS miles_sum, sum(trip_time) AS time_sum,
  sum(tips) AS tips_sum, {', '.join(f'sum(coalesce({c}, 0)) AS {c}_sum' for c in FEES)} FROM {F_}"""
cte("m_trips_daily", DAILY + " GROUP BY 1, 2")
BOOK = " + ".join(f"coalesce({c}, 0)" for c in FEES)
cte("m_monthly_provider", f"""SELECT CAST(date_trunc('month', pickup_datetime) AS DATE) AS month, {PROVIDER4} AS provider, count(*) AS trips,
  avg(base_passenger_fare) AS avg_fare, avg(driver_pay) AS avg_pay, sum({BOOK}) AS bookings, sum(base_passenger_fare) AS fare_sum, sum(driver_pay) AS pay_sum,
  100 * (1 - sum(driver_pay) / nullif(sum(base_passenger_fare), 0)) AS take_rate_pct FROM {F_} GROUP BY 1, 2""")


def _zone_sql(period, name, zone):
    return f"""SELECT {period} AS {name}, f.{zone} AS LocationID, z.zone, z.borough, count(*) AS trips, avg(base_passenger_fare) AS avg_fare,
  sum(base_passenger_fare) AS fare_sum, sum(driver_pay) AS pay_sum, sum(trip_time) AS time_sum, 3600 * sum(driver_pay) / nullif(sum(trip_time), 0) AS driver_hourly
FROM {F_} f JOIN zones z ON f.{zone} = z.LocationID GROUP BY 1, 2, 3, 4"""


cte("m_by_zone", _zone_sql("CAST(date_trunc('month', pickup_datetime) AS DATE)", "month", "PULocationID"))
cte("m_by_zone_daily", _zone_sql("CAST(pickup_datetime AS DATE)", "date", "PULocationID"))
cte("m_by_zone_do", _zone_sql("CAST(date_trunc('month', pickup_datetime) AS DATE)", "month", "DOLocationID"))
cte("m_segment_daily", f"""SELECT CAST(pickup_datetime AS DATE) AS date, {PROVIDER4} AS provider,
  CASE WHEN coalesce(wav_request_flag, 'N') = 'Y' OR coalesce(access_a_ride_flag, 'N') = 'Y' THEN 'wav'
       WHEN shared_request_flag = 'Y' OR shared_match_flag = 'Y' THEN 'shared' ELSE 'regular' END AS segment,
  count(*) AS trips, sum({BOOK}) AS bookings, sum(base_passenger_fare) AS fare, sum(driver_pay) AS pay, sum(base_passenger_fare - driver_pay) AS take
FROM complete_clean GROUP BY 1, 2, 3""")
cte("m_wait_long", f"""SELECT hour(request_datetime) AS hour, dayofweek(request_datetime) AS dow, {PROVIDER4} AS provider, 'citywide' AS wait_group,
    date_diff('second', request_datetime, pickup_datetime) AS w FROM complete_clean WHERE request_datetime IS NOT NULL AND on_scene_datetime IS NOT NULL
  UNION ALL SELECT hour(request_datetime), dayofweek(request_datetime), {PROVIDER4}, CASE PULocationID WHEN 132 THEN 'jfk' ELSE 'lga' END,
    date_diff('second', request_datetime, pickup_datetime) FROM complete_clean WHERE request_datetime IS NOT NULL AND on_scene_datetime IS NOT NULL AND PULocationID IN (132, 138)""")
cte("m_wait_hourly", """SELECT hour, dow, provider, wait_group, count(*) AS trips, avg(w) AS avg_wait, quantile_cont(w, .5) AS med_wait,
  quantile_cont(w, .9) AS p90_wait, var_samp(w) AS var_wait FROM m_wait_long GROUP BY 1, 2, 3, 4""")
cte("m_mile_bins", f"""SELECT {PROVIDER4} AS provider, CASE WHEN trip_miles < 1 THEN '0-1' WHEN trip_miles < 2 THEN '1-2' WHEN trip_miles < 5 THEN '2-5'
    WHEN trip_miles < 10 THEN '5-10' WHEN trip_miles < 20 THEN '10-20' ELSE '20+' END AS mile_bin,
  CASE WHEN trip_miles < 1 THEN 0 WHEN trip_miles < 2 THEN 1 WHEN trip_miles < 5 THEN 2 WHEN trip_miles < 10 THEN 3 WHEN trip_miles < 20 THEN 4 ELSE 5 END AS mile_bin_order,
  count(*) AS trips, 100 * (1 - sum(driver_pay) / nullif(sum(base_passenger_fare), 0)) AS take_rate_pct,
  sum(base_passenger_fare) / nullif(sum(trip_miles), 0) AS fare_per_mile FROM complete_clean GROUP BY 1, 2, 3""")


@register("zone_dimension_trips", "LocationID borough:str zone:str lat:real lon:real trips", f"""
SELECT z.*, coalesce(n, 0) AS trips FROM zones z LEFT JOIN (SELECT PULocationID, count(*) AS n FROM {F_} GROUP BY 1) c ON c.PULocationID = z.LocationID""")
def q_zones(spark, d):
    from pyspark.sql import functions as F
    counts = trips(spark, d).groupBy(F.col("PULocationID").alias("LocationID")).agg(F.count(F.lit(1)).alias("trips"))
    return T("zones")(spark, d).join(counts, "LocationID", "left").fillna(0, ["trips"])


@register("ov_trips", "l_orderkey l_linenumber provider:str pickup_datetime:ts", f"SELECT *, {PROVIDER4} AS provider FROM (SELECT DISTINCT * FROM raw_fhvhv) r")
def q_trips(spark, d):
    return O.trips(T("raw_fhvhv")(spark, d))


@register("trips_daily", DAILY_SPEC, "SELECT * FROM m_trips_daily")
def q_daily(spark, d):
    return O.trips_daily(trips(spark, d))


@register("trips_cbd_daily", DAILY_SPEC, DAILY + " WHERE cbd_congestion_fee > 0 GROUP BY 1, 2")
def q_cbd(spark, d):
    return O.trips_cbd_daily(trips(spark, d))


HOURLY = f"SELECT CAST(pickup_datetime AS DATE) AS date, hour(pickup_datetime) AS hour, count(*) AS trips FROM {F_} GROUP BY 1, 2"


@register("trips_hourly_dow_daily", "date:date hour trips", HOURLY)
def q_hourly_daily(spark, d):
    return O.trips_hourly_dow_daily(trips(spark, d))


@register("trips_hourly_dow", "dow hour trips", f"SELECT dayofweek(pickup_datetime) AS dow, hour(pickup_datetime) AS hour, count(*) AS trips FROM {F_} GROUP BY 1, 2")
def q_hourly_dow(spark, d):
    return O.trips_hourly_dow(O.trips_hourly_dow_daily(trips(spark, d)))


HOURS = " ".join(f"h{h}" for h in range(24))


@register("trips_heatmap", f"dow {HOURS}", "SELECT dayofweek(pickup_datetime) AS dow, " + ", ".join(
    f"count(*) FILTER (WHERE hour(pickup_datetime) = {h}) AS h{h}" for h in range(24)) + f" FROM {F_} GROUP BY 1")
def q_heatmap(spark, d):
    return O.trips_heatmap(O.trips_hourly_dow(O.trips_hourly_dow_daily(trips(spark, d))))


ZONE_SPEC = "LocationID zone:str borough:str trips avg_fare:real fare_sum:real pay_sum:real time_sum driver_hourly:real"


@register("trips_by_zone", f"month:date {ZONE_SPEC}", "SELECT * FROM m_by_zone")
def q_by_zone(spark, d):
    return O.trips_by_zone(trips(spark, d), T("zones")(spark, d))


@register("trips_by_zone_daily", f"date:date {ZONE_SPEC}", "SELECT * FROM m_by_zone_daily")
def q_by_zone_daily(spark, d):
    return O.trips_by_zone_daily(trips(spark, d), T("zones")(spark, d))


@register("trips_by_zone_do", f"month:date {ZONE_SPEC}", "SELECT * FROM m_by_zone_do")
def q_by_zone_do(spark, d):
    return O.trips_by_zone_do(trips(spark, d), T("zones")(spark, d))


@register("weather_daily", "date:date prcp_mm:real snow_mm:real tmax_c:real awnd_ms:real", "SELECT * FROM weather")
def q_weather(spark, d):
    return T("weather")(spark, d)


@register("take_rate_benchmarks", "entity:str take_rate_pct:real", """
SELECT 'Uber' AS entity, 25.4 AS take_rate_pct UNION ALL SELECT 'Lyft', 33.5
UNION ALL SELECT 'NYC', 100 * (1 - sum(pay_sum) / nullif(sum(fare_sum), 0)) FROM m_monthly_provider""")
def q_bench(spark, d):
    return O.benchmarks(spark, O.trips_monthly_provider(trips(spark, d)))


@register("trips_monthly_provider", "month:date provider:str trips avg_fare:real avg_pay:real bookings:real fare_sum:real pay_sum:real take_rate_pct:real", "SELECT * FROM m_monthly_provider")
def q_monthly(spark, d):
    return O.trips_monthly_provider(trips(spark, d))


INC = "(coalesce(wav_request_flag, 'N') = 'Y' OR coalesce(access_a_ride_flag, 'N') = 'Y')"


@register("wav_hourly_zone", "hour provider:str PULocationID trips inclusive ordinary_wav ordinary_regular", f"""
SELECT hour(pickup_datetime) AS hour, {PROVIDER4} AS provider, PULocationID, count(*) AS trips, count(*) FILTER (WHERE {INC}) AS inclusive,
  count(*) FILTER (WHERE NOT {INC} AND wav_match_flag = 'Y') AS ordinary_wav, count(*) FILTER (WHERE NOT {INC} AND wav_match_flag <> 'Y') AS ordinary_regular
FROM complete_clean GROUP BY 1, 2, 3""")
def q_wav_hourly(spark, d):
    return O.wav_hourly_zone(clean(spark, d))


@register("wav_wait_fact", "date:date provider:str PULocationID segment:str wait_sec", f"""
SELECT CAST(pickup_datetime AS DATE) AS date, {PROVIDER4} AS provider, PULocationID,
  CASE WHEN {INC} THEN 'inclusive' WHEN wav_match_flag = 'Y' THEN 'ordinary_wav' ELSE 'ordinary_regular' END AS segment,
  date_diff('second', request_datetime, pickup_datetime) AS wait_sec FROM complete_clean WHERE request_datetime IS NOT NULL""")
def q_wait_fact(spark, d):
    return O.wav_wait_fact(clean(spark, d))


@register("mart_shared_zone", "date:date provider:str LocationID zone:str trips shared_requests matched shared_trips fare_sum:real", f"""
SELECT CAST(pickup_datetime AS DATE) AS date, {PROVIDER2} AS provider, LocationID, z.zone, count(*) AS trips, count(*) FILTER (WHERE shared_request_flag = 'Y') AS shared_requests,
  count(*) FILTER (WHERE shared_request_flag = 'Y' AND shared_match_flag = 'Y') AS matched,
  count(*) FILTER (WHERE shared_request_flag = 'Y' OR shared_match_flag = 'Y') AS shared_trips, sum(base_passenger_fare) AS fare_sum
FROM complete_clean c JOIN zones z ON c.PULocationID = z.LocationID WHERE hvfhs_license_num IN ('HV0003', 'HV0005') GROUP BY 1, 2, 3, 4""")
def q_shared_zone(spark, d):
    return O.mart_shared_zone(clean(spark, d), T("zones")(spark, d))


@register("mart_segment_daily", "date:date provider:str segment:str trips bookings:real fare:real pay:real take:real", "SELECT * FROM m_segment_daily")
def q_segment(spark, d):
    return O.mart_segment_daily(clean(spark, d))


@register("wait_hourly_provider", "hour dow provider:str wait_group:str trips avg_wait:real med_wait:real p90_wait:real var_wait:real", "SELECT * FROM m_wait_hourly")
def q_wait_hourly(spark, d):
    return O.wait_hourly_provider(clean(spark, d))


@register("surge_hourly_provider", "hour dow provider:str trips fare_per_mile:real avg_trip_fpm:real var_trip_fpm:real", f"""
SELECT hour(pickup_datetime) AS hour, dayofweek(pickup_datetime) AS dow, {PROVIDER2} AS provider, count(*) AS trips, sum(base_passenger_fare) / sum(trip_miles) AS fare_per_mile,
  avg(base_passenger_fare / trip_miles) AS avg_trip_fpm, var_samp(base_passenger_fare / trip_miles) AS var_trip_fpm
FROM complete_clean WHERE hvfhs_license_num IN ('HV0003', 'HV0005') AND trip_miles >= 2 AND trip_miles < 5 GROUP BY 1, 2, 3""")
def q_surge(spark, d):
    return O.surge_hourly_provider(clean(spark, d))


@register("mile_bin_pricing", "provider:str mile_bin:str mile_bin_order trips take_rate_pct:real fare_per_mile:real", "SELECT * FROM m_mile_bins")
def q_bins(spark, d):
    return O.mile_bin_pricing(clean(spark, d))
