"""Main-suite marts."""

from pyspark.sql import functions as F

from catalog.base import T, cte, register
from tripmarts.operators import clean as C
from tripmarts.plans import suite as M

BASE_MONTH, BASE_YEAR = "1996-01-01", 1996
WAIT = "med_wait_sec:real avg_wait_sec:real n_trips"
WAIT_SQL = "median(wait_sec) AS med_wait_sec, avg(wait_sec) AS avg_wait_sec, count(*) AS n_trips"


def base(spark, d):
    return M.wait_rows(C.wait_trips(T("fhvhv_trips")(spark, d)))


def all_trips(spark, d):
    return M.union_families({
        "yellow": (T("yellow_trips")(spark, d), "tpep_pickup_datetime", "PULocationID"),
        "green": (T("green_trips")(spark, d), "lpep_pickup_datetime", "PULocationID"),
        "fhvhv": (T("fhvhv_trips")(spark, d), "pickup_datetime", "PULocationID"),
        "fhv": (T("fhv_trips")(spark, d), "pickup_datetime", "PUlocationID")})


def citywide(spark, d):
    return M.daily_citywide(T("fhvhv_trips")(spark, d), T("weather")(spark, d), T("transit")(spark, d))


def by_borough(spark, d):
    return M.daily_by_borough(T("fhvhv_trips")(spark, d), T("zones")(spark, d))


@register("wait_marts_from_one_base", "mart:str rows", """
SELECT 'zone_wait_time' AS mart, count(DISTINCT zone) AS rows FROM waits UNION ALL SELECT 'zone_wait_by_aggregator', count(DISTINCT (zone, aggregator)) FROM waits
UNION ALL SELECT 'wait_by_hour_dow', count(DISTINCT (hr, dow)) FROM waits UNION ALL SELECT 'wait_by_hour_dow_aggregator', count(DISTINCT (hr, dow, aggregator)) FROM waits
UNION ALL SELECT 'zone_wait_by_period', count(DISTINCT zone) + count(DISTINCT (zone, period)) FROM waits
UNION ALL SELECT 'zone_wait_by_period_agg', count(DISTINCT zone) + count(DISTINCT (zone, period)) + count(DISTINCT (zone, aggregator)) + count(DISTINCT (zone, period, aggregator)) FROM waits""")
def wait_marts(spark, d):
    marts = M.wait_marts(M.wait_base(C.wait_trips(T("fhvhv_trips")(spark, d))))
    out = None
    for name, df in marts.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("mart", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@register("zone_wait_time", f"zone {WAIT}", f"SELECT zone, {WAIT_SQL} FROM waits GROUP BY 1")
def zone_wait_time(spark, d):
    return M.zone_wait_time(base(spark, d))


@register("zone_wait_by_period", f"zone period:str {WAIT}", f"""
SELECT zone, period, {WAIT_SQL} FROM waits GROUP BY 1, 2 UNION ALL SELECT zone, 'all', {WAIT_SQL} FROM waits GROUP BY 1""")
def zone_wait_by_period(spark, d):
    return M.zone_wait_by_period(base(spark, d))


@register("zone_wait_by_aggregator", f"zone aggregator:str {WAIT}", f"SELECT zone, aggregator, {WAIT_SQL} FROM waits GROUP BY 1, 2")
def zone_wait_by_aggregator(spark, d):
    return M.zone_wait_by_aggregator(base(spark, d))


@register("zone_wait_cube", f"zone period:str aggregator:str {WAIT}", f"""
SELECT zone, period, aggregator, {WAIT_SQL} FROM waits GROUP BY 1, 2, 3
UNION ALL SELECT zone, 'all', aggregator, {WAIT_SQL} FROM waits GROUP BY zone, aggregator
UNION ALL SELECT zone, period, 'all', {WAIT_SQL} FROM waits GROUP BY zone, period
UNION ALL SELECT zone, 'all', 'all', {WAIT_SQL} FROM waits GROUP BY zone""")
def zone_wait_cube(spark, d):
    return M.zone_wait_cube(base(spark, d))


@register("wait_by_hour_dow", f"hour dow {WAIT}", f"SELECT hr AS hour, dow, {WAIT_SQL} FROM waits GROUP BY 1, 2")
def wait_by_hour_dow(spark, d):
    return M.wait_by_hour_dow(base(spark, d))


@register("wait_by_hour_dow_aggregator", f"hour dow aggregator:str {WAIT}", "SELECT * FROM m_hour_dow_agg")
def wait_by_hour_dow_aggregator(spark, d):
    return M.wait_by_hour_dow(base(spark, d), True)


@register("provider_wait_peek", "aggregator:str city_med:real trips", """
SELECT aggregator, median(med_wait_sec) AS city_med, sum(n_trips) AS trips FROM m_zone_wait_agg GROUP BY 1""")
def provider_peek(spark, d):
    return M.provider_peek(M.zone_wait_by_aggregator(base(spark, d)))


@register("zone_wait_p90", "zone p50:real p90:real p95:real", """
SELECT zone, quantile_cont(wait_sec, .5) AS p50, quantile_cont(wait_sec, .9) AS p90, quantile_cont(wait_sec, .95) AS p95 FROM waits GROUP BY 1""")
def zone_quantiles(spark, d):
    from tripmarts.operators.quantile import hist_quantile
    return M._regroup(base(spark, d), ["zone"]).groupBy("zone").agg(
        *[hist_quantile("wait_sec", q).alias(n) for n, q in (("p50", .5), ("p90", .9), ("p95", .95))])


@register("monthly_by_type", "month:date taxi_type:str trips", "SELECT * FROM m_monthly_by_type")
def monthly_by_type(spark, d):
    return M.monthly_by_type(all_trips(spark, d))


@register("monthly_by_type_indexed", "month:date taxi_type:str trips index_base_100:real", """
SELECT month, taxi_type, trips, 100.0 * trips / max(CASE WHEN month = DATE '1996-01-01' THEN trips END) OVER (PARTITION BY taxi_type) AS index_base_100
FROM m_monthly_by_type""")
def monthly_by_type_indexed(spark, d):
    return M.monthly_by_type_indexed(monthly_by_type(spark, d), BASE_MONTH)


@register("monthly_by_type_indexed_self", "month:date taxi_type:str trips index_base_100:real", """
SELECT month, taxi_type, trips, 100.0 * trips / coalesce(max(CASE WHEN month = DATE '1890-01-01' THEN trips END) OVER (PARTITION BY taxi_type), trips) AS index_base_100
FROM m_monthly_by_type""")
def monthly_by_type_self(spark, d):
    return M.monthly_by_type_indexed(monthly_by_type(spark, d), "1890-01-01", fallback="self")


@register("aggregator_monthly", "month:date aggregator:str trips share_pct:real", "SELECT * FROM m_aggregator_monthly")
def aggregator_monthly(spark, d):
    return M.aggregator_monthly(T("fhvhv_trips")(spark, d))


@register("aggregator_monthly_indexed", "month:date aggregator:str trips share_pct:real index_base_100:real", """
SELECT *, 100.0 * trips / max(CASE WHEN month = DATE '1996-01-01' THEN trips END) OVER (PARTITION BY aggregator) AS index_base_100 FROM m_aggregator_monthly""")
def aggregator_monthly_indexed(spark, d):
    return M.aggregator_monthly_indexed(aggregator_monthly(spark, d), BASE_MONTH)


@register("yearly_aggregator_indexed", "year aggregator:str trips index_base_100:real", """
SELECT *, 100.0 * trips / max(CASE WHEN year = 1996 THEN trips END) OVER (PARTITION BY aggregator) AS index_base_100
FROM (SELECT year(month) AS year, aggregator, sum(trips) AS trips FROM m_aggregator_monthly GROUP BY 1, 2) y""")
def yearly_aggregator(spark, d):
    return M.yearly_aggregator_indexed(aggregator_monthly(spark, d), BASE_YEAR)


@register("daily_citywide", "date:date trips fare_per_mile:real prcp_mm:real snow_mm:real tmax_c:real subway_ridership", "SELECT * FROM m_daily_citywide")
def daily_citywide(spark, d):
    return citywide(spark, d)


@register("daily_by_borough", "date:date borough:str trips fare_per_mile:real", "SELECT * FROM m_daily_by_borough")
def daily_by_borough(spark, d):
    return by_borough(spark, d)


@register("monthly_by_borough", "month:date borough:str trips", "SELECT * FROM m_monthly_by_borough")
def monthly_by_borough(spark, d):
    return M.monthly_by_borough(by_borough(spark, d))


@register("monthly_transit", "month:date ridership:real", "SELECT * FROM m_monthly_transit")
def monthly_transit(spark, d):
    return M.monthly_transit(citywide(spark, d))


def recovery(spark, d):
    c = citywide(spark, d)
    return M.monthly_recovery(monthly_by_borough(spark, d), M.monthly_transit(c), c, BASE_MONTH, ("1996-03-01", "1996-03-11"))


@register("monthly_recovery_indexed", "month:date series:str trips:real index_base_100:real", "SELECT * FROM m_recovery")
def monthly_recovery(spark, d):
    return recovery(spark, d)


@register("yearly_recovery_indexed", "year series:str index_base_100:real trips:real", """
SELECT year(month) AS year, series, avg(index_base_100) AS index_base_100, sum(trips) AS trips FROM m_recovery GROUP BY 1, 2""")
def yearly_recovery(spark, d):
    return M.yearly_recovery(recovery(spark, d))


@register("aggregator_by_borough", "borough:str aggregator:str trips share_pct:real", "SELECT * FROM m_provider_borough")
def aggregator_by_borough(spark, d):
    return M.provider_by_borough(T("fhvhv_trips")(spark, d), T("zones")(spark, d), BASE_YEAR)


@register("zone_dominant_type", "zone yellow green fhvhv fhv total dominant_type:str dominant_share_pct:real zone_name:str borough:str",
          "SELECT * FROM m_dominant_type")
def zone_dominant_type(spark, d):
    return M.zone_dominant_type(all_trips(spark, d), T("zones")(spark, d), BASE_YEAR)


@register("zone_dominant_aggregator", "zone Juno Lyft Uber Via total dominant_aggregator:str dominant_share_pct:real zone_name:str borough:str",
          "SELECT * FROM m_dominant_agg")
def zone_dominant_aggregator(spark, d):
    return M.zone_dominant_aggregator(T("fhvhv_trips")(spark, d), T("zones")(spark, d), BASE_YEAR)


@register("day_zone_volume", "date:date zone trips fare:real miles:real", """
SELECT CAST(pickup_datetime AS DATE) AS date, PULocationID AS zone, count(*) AS trips, sum(base_passenger_fare) AS fare, sum(trip_miles) AS miles
FROM fhvhv_trips GROUP BY 1, 2""")
def day_zone_volume(spark, d):
    return M.day_zone_volume(T("fhvhv_trips")(spark, d))


@register("daily_families_weather", "date:date yellow green fhvhv prcp_mm:real tmax_c:real is_weekend:bool", """
SELECT c.date, yellow, green, fhvhv, w.prcp_mm, w.tmax_c, dayofweek(c.date) IN (0, 6) AS is_weekend FROM (
  SELECT CAST(pickup_datetime AS DATE) AS date, count(*) FILTER (WHERE taxi_type = 'yellow') AS yellow,
    count(*) FILTER (WHERE taxi_type = 'green') AS green, count(*) FILTER (WHERE taxi_type = 'fhvhv') AS fhvhv
  FROM all_trips GROUP BY 1) c JOIN weather w ON c.date = w.date""")
def daily_families(spark, d):
    return M.daily_families(all_trips(spark, d), T("weather")(spark, d), ["yellow", "green", "fhvhv"])


@register("north_star_by_year", "year trips n_days avg_daily_trips:real", """
SELECT year(pickup_datetime) AS year, count(*) AS trips, count(DISTINCT CAST(pickup_datetime AS DATE)) AS n_days,
  1.0 * count(*) / count(DISTINCT CAST(pickup_datetime AS DATE)) AS avg_daily_trips FROM all_trips GROUP BY 1""")
def north_star(spark, d):
    return M.north_star(all_trips(spark, d))


cte("pay_rows", """SELECT year(pickup_datetime) AS year, CASE WHEN w > 0 AND w < 3600 THEN w END AS wait_sec, CASE WHEN trip_time > 60 THEN driver_pay END AS pay, trip_time / 3600.0 AS hours
FROM (SELECT *, CAST(epoch(pickup_datetime) - epoch(request_datetime) AS BIGINT) AS w FROM fhvhv_trips) q""")
PAY = """SELECT year, quantile_cont(wait_sec, 0.5) AS med_wait_sec, quantile_cont(wait_sec, 0.9) AS p90_wait_sec, quantile_cont(pay / hours, 0.5) AS med_hourly_pay,
  quantile_cont(pay, 0.5) AS med_pay_per_trip FROM pay_rows GROUP BY year"""
MATCHES = """SELECT year(pickup_datetime) AS year, count(*) FILTER (WHERE shared_request_flag = 'Y') AS requested,
  count(*) FILTER (WHERE shared_request_flag = 'Y' AND shared_match_flag = 'Y') AS n_matched FROM fhvhv_trips GROUP BY 1"""
FPM = """SELECT year(pickup_datetime) AS year, quantile_cont(base_passenger_fare / trip_miles, 0.5) AS med_fare_per_mile
FROM fhvhv_trips WHERE trip_miles > 0.1 GROUP BY 1"""
cte("hour_zone_cells", """SELECT CAST(floor(epoch(pickup_datetime) / 3600) AS BIGINT) AS hour_number, year(pickup_datetime) AS year, PULocationID AS zone, count(*) AS n
FROM fhvhv_trips GROUP BY ALL""")
LIQ = """SELECT year, avg(per_zone) AS avg_trips_per_active_zone_hour, avg(active) AS avg_active_zones FROM (
  SELECT year, hour_number, count(zone) AS active, sum(n) * 1.0 / count(zone) AS per_zone FROM hour_zone_cells GROUP BY ALL) q GROUP BY year"""


@register("wait_and_pay_by_year", "year med_wait_sec:real p90_wait_sec:real med_hourly_pay:real med_pay_per_trip:real", PAY)
def wait_and_pay(spark, d):
    return M.wait_and_pay(T("fhvhv_trips")(spark, d))


@register("wait_and_pay_approx_by_year", "year med_wait_sec:real p90_wait_sec:real med_hourly_pay:real med_pay_per_trip:real")
def wait_and_pay_approx(spark, d):
    return M.wait_and_pay(T("fhvhv_trips")(spark, d), exact=False)


@register("shared_match_by_year", "year requested n_matched", MATCHES)
def shared_match_by_year(spark, d):
    return M.shared_match_by_year(T("fhvhv_trips")(spark, d))


@register("fare_per_mile_by_year", "year med_fare_per_mile:real", FPM)
def fare_per_mile(spark, d):
    return M.fare_per_mile_by_year(T("fhvhv_trips")(spark, d))


@register("liquidity_by_year", "year avg_trips_per_active_zone_hour:real avg_active_zones:real", LIQ)
def liquidity(spark, d):
    return M.liquidity_by_year(T("fhvhv_trips")(spark, d))


@register("product_metrics_yearly", "year trips n_days avg_daily_trips:real med_wait_sec:real p90_wait_sec:real med_hourly_pay:real "
          "med_pay_per_trip:real requested n_matched med_fare_per_mile:real avg_trips_per_active_zone_hour:real avg_active_zones:real", f"""
SELECT n.*, p.med_wait_sec, p.p90_wait_sec, p.med_hourly_pay, p.med_pay_per_trip, m.requested, m.n_matched, f.med_fare_per_mile,
  l.avg_trips_per_active_zone_hour, l.avg_active_zones
FROM (SELECT year(pickup_datetime) AS year, count(*) AS trips, count(DISTINCT CAST(pickup_datetime AS DATE)) AS n_days,
  1.0 * count(*) / count(DISTINCT CAST(pickup_datetime AS DATE)) AS avg_daily_trips FROM all_trips GROUP BY 1) n
LEFT JOIN ({PAY}) p ON n.year = p.year LEFT JOIN ({MATCHES}) m ON n.year = m.year
LEFT JOIN ({FPM}) f ON n.year = f.year LEFT JOIN ({LIQ}) l ON n.year = l.year""")
def product_metrics(spark, d):
    return M.product_metrics_yearly(all_trips(spark, d), T("fhvhv_trips")(spark, d))


@register("zone_timelapse", "profile:str zone hr avg_trips:real", """
SELECT CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS profile, zone, hr, avg(n) AS avg_trips FROM (
  SELECT PULocationID AS zone, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, CAST(pickup_datetime AS DATE) AS day_, count(*) AS n
  FROM fhvhv_trips WHERE PULocationID IS NOT NULL GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3""")
def timelapse(spark, d):
    return M.zone_timelapse(T("fhvhv_trips")(spark, d))


@register("zone_timelapse_ramp", "profile:str zone hr avg_trips:real lo:real hi:real position:real", """
SELECT t.*, lo, hi, greatest(0.0, least(1.0, (avg_trips - lo) / nullif(hi - lo, 0))) AS position FROM (
  SELECT CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS profile, zone, hr, avg(n) AS avg_trips FROM (
    SELECT PULocationID AS zone, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, CAST(pickup_datetime AS DATE) AS day_, count(*) AS n
    FROM fhvhv_trips GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3) t
JOIN (SELECT profile, quantile_cont(avg_trips, .05) AS lo, quantile_cont(avg_trips, .95) AS hi FROM (
  SELECT CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS profile, zone, hr, avg(n) AS avg_trips FROM (
    SELECT PULocationID AS zone, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, CAST(pickup_datetime AS DATE) AS day_, count(*) AS n
    FROM fhvhv_trips GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3) t GROUP BY 1) r ON t.profile = r.profile""")
def timelapse_ramp(spark, d):
    return M.ramp_position(M.zone_timelapse(T("fhvhv_trips")(spark, d)), "avg_trips", ["profile"])


@register("zone_metric_matrix", "zone zone_name:str borough:str period:str aggregator:str n_trips shown_wait_sec:real lo:real hi:real position:real", f"""
SELECT c.zone, z.zone AS zone_name, z.borough, c.period, c.aggregator, n_trips, shown_wait_sec, lo, hi,
  CASE WHEN shown_wait_sec IS NOT NULL THEN greatest(0.0, least(1.0, (shown_wait_sec - lo) / nullif(hi - lo, 0))) END AS position
FROM (SELECT zone, period, aggregator, n_trips, CASE WHEN n_trips >= 10 THEN med_wait_sec END AS shown_wait_sec,
    quantile_cont(CASE WHEN n_trips >= 10 THEN med_wait_sec END, .05) OVER (PARTITION BY period, aggregator) AS lo,
    quantile_cont(CASE WHEN n_trips >= 10 THEN med_wait_sec END, .95) OVER (PARTITION BY period, aggregator) AS hi
  FROM (SELECT zone, period, aggregator, {WAIT_SQL} FROM waits GROUP BY 1, 2, 3
    UNION ALL SELECT zone, 'all', aggregator, {WAIT_SQL} FROM waits GROUP BY zone, aggregator
    UNION ALL SELECT zone, period, 'all', {WAIT_SQL} FROM waits GROUP BY zone, period
    UNION ALL SELECT zone, 'all', 'all', {WAIT_SQL} FROM waits GROUP BY zone) q) c
LEFT JOIN zones z ON c.zone = z.LocationID""")
def matrix(spark, d):
    return M.zone_metric_matrix(M.zone_wait_cube(base(spark, d)), T("zones")(spark, d), min_n=10)


@register("zone_year_panel", "zone year yellow green fhvhv fhv total log_yellow:real log_green:real log_fhvhv:real fhvhv_share:real fhvhv_share_of_pair:real", """
SELECT *, yellow + green + fhvhv + fhv AS total, ln(greatest(yellow, 1)) AS log_yellow, ln(greatest(green, 1)) AS log_green, ln(greatest(fhvhv, 1)) AS log_fhvhv,
  1.0 * fhvhv / nullif(yellow + green + fhvhv + fhv, 0) AS fhvhv_share, 1.0 * fhvhv / nullif(fhvhv + green, 0) AS fhvhv_share_of_pair
FROM (SELECT zone, year(pickup_datetime) AS year, count(*) FILTER (WHERE taxi_type = 'yellow') AS yellow, count(*) FILTER (WHERE taxi_type = 'green') AS green,
  count(*) FILTER (WHERE taxi_type = 'fhvhv') AS fhvhv, count(*) FILTER (WHERE taxi_type = 'fhv') AS fhv FROM all_trips WHERE zone IS NOT NULL GROUP BY 1, 2) q""")
def zone_year_panel(spark, d):
    return M.zone_year_panel(all_trips(spark, d))


@register("recovery_by_type", "taxi_type:str base_trips trips_1997 trips_1998 recovery_1997_pct:real recovery_1998_pct:real", """
SELECT *, 100.0 * trips_1997 / nullif(base_trips, 0) AS recovery_1997_pct, 100.0 * trips_1998 / nullif(base_trips, 0) AS recovery_1998_pct FROM (
  SELECT taxi_type, sum(trips) FILTER (WHERE year(month) = 1996) AS base_trips, sum(trips) FILTER (WHERE year(month) = 1997) AS trips_1997,
    sum(trips) FILTER (WHERE year(month) = 1998) AS trips_1998 FROM m_monthly_by_type GROUP BY 1) q""")
def recovery_by_type(spark, d):
    return M.recovery_by_type(monthly_by_type(spark, d), BASE_YEAR, [1997, 1998])
