"""Accessibility marts and analyses."""

from pyspark.sql import functions as F

from catalog.base import T, register
from tripmarts.operators import clean as C
from tripmarts.plans import access as A


def core(spark, d):
    return C.access_trips(T("fhvhv_trips")(spark, d))


def cells(spark, d):
    return A.dashboard_cells(core(spark, d))


def monthly(spark, d):
    return A.monthly_metrics(core(spark, d))


CELLS = "all_trips wav_trips accessibility_trips ordinary_trips ordinary_wav_trips ordinary_nonwav_trips"


@register("wav_dashboard_cells", f"date:date dow hour provider:str PULocationID {CELLS}", "SELECT * FROM m_cells")
def q_cells(spark, d):
    return cells(spark, d)


@register("wav_dashboard_wait_summary", "provider:str segment:str trips valid_wait_n on_scene_wait_n pickup_proxy_n excluded_negative_n "
          "excluded_on_scene_after_pickup_n mean_min:real p50_min:real p95_min:real", """
SELECT provider, segment, count(*) AS trips, count(adjusted_wait_sec) AS valid_wait_n, CAST(sum(CAST(used_on_scene AS INTEGER)) AS BIGINT) AS on_scene_wait_n,
  CAST(sum(CAST(used_pickup_proxy AS INTEGER)) AS BIGINT) AS pickup_proxy_n, CAST(coalesce(sum(CAST(excluded_negative AS INTEGER)), 0) AS BIGINT) AS excluded_negative_n,
  CAST(coalesce(sum(CAST(excluded_on_scene_after_pickup AS INTEGER)), 0) AS BIGINT) AS excluded_on_scene_after_pickup_n,
  avg(adjusted_wait_sec) / 60 AS mean_min, quantile_cont(adjusted_wait_sec, .5) / 60 AS p50_min, quantile_cont(adjusted_wait_sec, .95) / 60 AS p95_min
FROM (SELECT * FROM adjusted UNION ALL SELECT * REPLACE ('Все' AS provider) FROM adjusted) q GROUP BY provider, segment""")
def wait_summary(spark, d):
    return A.wait_summary(core(spark, d))


@register("wav_v2_date_hour", "date:date hour provider:str exact_segment:str accessibility_segment:str trips", "SELECT * FROM m_date_hour")
def q_date_hour(spark, d):
    return A.date_hour(core(spark, d))


@register("wav_v2_monthly_metrics", "month:date provider:str accessibility_segment:str trips wav_request_n wav_match_n arrival_n arrival_mean_min:real "
          "arrival_p50_min:real arrival_p95_min:real boarding_n boarding_mean_min:real boarding_p50_min:real boarding_p95_min:real economics_n "
          "base_fare_per_mile:real base_fare_per_min:real mean_miles:real mean_duration_min:real aggregate_speed_mph:real tipped_n "
          "tipped_share_pct:real mean_tip_positive:real", "SELECT * FROM m_monthly_metrics")
def q_monthly(spark, d):
    return monthly(spark, d)


@register("wav_v2_zone_metrics", "direction:str LocationID total_trips accessibility_trips wav_request_trips aar_no_request_trips accessibility_share_pct:real",
          "SELECT * FROM m_zone_metrics")
def q_zone_metrics(spark, d):
    return A.zone_metrics(core(spark, d))


@register("wait_hist_daily", "date:date segment:str wait_bin_min:real trips", "SELECT * FROM m_wait_hist")
def q_wait_hist(spark, d):
    return A.wait_hist_daily(core(spark, d))


@register("access_peak_counts", "high_demand:bool ordinary_trips ordinary_wav_trips", """
SELECT high_demand, sum(ordinary_trips) AS ordinary_trips, sum(ordinary_wav_trips) AS ordinary_wav_trips FROM m_cells_peak GROUP BY 1""")
def q_peak(spark, d):
    return A.peak_counts(cells(spark, d))


@register("access_peak_daily", "date:date high_demand:bool ordinary_trips ordinary_wav_trips", """
SELECT date, high_demand, sum(ordinary_trips) AS ordinary_trips, sum(ordinary_wav_trips) AS ordinary_wav_trips FROM m_cells_peak GROUP BY 1, 2""")
def q_peak_daily(spark, d):
    return A.peak_daily(cells(spark, d))


@register("access_peak_zone", "provider:str zone_id high_demand:bool ordinary_trips ordinary_wav_trips", """
SELECT provider, PULocationID AS zone_id, high_demand, sum(ordinary_trips) AS ordinary_trips, sum(ordinary_wav_trips) AS ordinary_wav_trips
FROM m_cells_peak GROUP BY 1, 2, 3 HAVING sum(ordinary_trips) > 0""")
def q_peak_zone(spark, d):
    return A.peak_zone(cells(spark, d))


@register("access_hourly_daily", "date:date provider:str dow hour all_trips accessibility_trips ordinary_trips", """
SELECT date, provider, dow, hour, sum(all_trips) AS all_trips, sum(accessibility_trips) AS accessibility_trips, sum(ordinary_trips) AS ordinary_trips
FROM m_cells GROUP BY 1, 2, 3, 4""")
def q_hourly_daily(spark, d):
    return A.hourly_daily(cells(spark, d))


@register("access_exact_segments", "exact_segment:str trips share_pct:real", """
SELECT l.s AS exact_segment, coalesce(n, 0) AS trips, 100.0 * coalesce(n, 0) / (SELECT sum(trips) FROM m_date_hour) AS share_pct FROM (VALUES
  ('Не WAV, не AAR, не WAV request'), ('WAV без AAR и WAV request'), ('AAR без WAV и WAV request'), ('WAV request без WAV и AAR'),
  ('WAV + WAV request, не AAR'), ('AAR + WAV request, не WAV'), ('WAV + AAR, без WAV request'), ('WAV + AAR + WAV request')) AS l(s)
LEFT JOIN (SELECT exact_segment, sum(trips) AS n FROM m_date_hour GROUP BY 1) c ON l.s = c.exact_segment""")
def q_exact(spark, d):
    return A.exact_segment_counts(A.date_hour(core(spark, d)))


@register("access_three_segments", "accessibility_segment:str trips share_pct:real share_inside_pct:real", """
SELECT accessibility_segment, n AS trips, 100.0 * n / sum(n) OVER () AS share_pct,
  CASE WHEN accessibility_segment <> 'Остальные' THEN 100.0 * n / sum(n) FILTER (WHERE accessibility_segment <> 'Остальные') OVER () END AS share_inside_pct
FROM (SELECT accessibility_segment, sum(trips) AS n FROM m_date_hour GROUP BY 1) q""")
def q_three(spark, d):
    return A.access_segment_counts(A.date_hour(core(spark, d)))


@register("access_daily_segments", "date:date wav_request aar_no_request all_trips access_share_pct:real wav_request_ma7:real aar_no_request_ma7:real access_share_pct_ma7:real", """
SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(wav_request) OVER w END AS wav_request_ma7,
  CASE WHEN count(*) OVER w = 7 THEN avg(aar_no_request) OVER w END AS aar_no_request_ma7,
  CASE WHEN count(*) OVER w = 7 THEN avg(access_share_pct) OVER w END AS access_share_pct_ma7
FROM (SELECT date, coalesce(sum(trips) FILTER (WHERE accessibility_segment = 'WAV request'), 0) AS wav_request,
  coalesce(sum(trips) FILTER (WHERE accessibility_segment = 'AAR без WAV request'), 0) AS aar_no_request, sum(trips) AS all_trips,
  100.0 * coalesce(sum(trips) FILTER (WHERE accessibility_segment <> 'Остальные'), 0) / sum(trips) AS access_share_pct FROM m_date_hour GROUP BY 1) q
WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_daily_segments(spark, d):
    return A.daily_segments(A.date_hour(core(spark, d)))


@register("access_latest_vs_year_before", "accessibility_segment:str month:date trips trips_prev share_pct:real share_prev_pct:real change_pct:real share_change_pp:real", """
SELECT accessibility_segment, month, trips, trips_prev, share_pct, share_prev_pct, 100.0 * (1.0 * trips / nullif(trips_prev, 0) - 1) AS change_pct, share_pct - share_prev_pct AS share_change_pp FROM (
  SELECT accessibility_segment, max(latest) AS month, coalesce(max(CASE WHEN month = latest THEN trips END), 0) AS trips, coalesce(max(CASE WHEN month < latest THEN trips END), 0) AS trips_prev,
    max(CASE WHEN month = latest THEN sh END) AS share_pct, max(CASE WHEN month < latest THEN sh END) AS share_prev_pct
  FROM (SELECT month, accessibility_segment, trips, latest, 100.0 * trips / sum(trips) OVER (PARTITION BY month) AS sh FROM (
      SELECT month, accessibility_segment, trips, (SELECT max(month) FROM m_monthly_metrics) AS latest FROM m_monthly_metrics WHERE provider = 'Все' AND month IS NOT NULL) a
    WHERE month = latest OR month = CAST(latest - INTERVAL '12' MONTH AS DATE)) b WHERE accessibility_segment <> 'Остальные' GROUP BY 1) c""")
def q_latest(spark, d):
    return A.latest_vs_year_before(monthly(spark, d))


@register("access_match_share", "month:date wav_request_n wav_match_n match_share_pct:real", """
SELECT month, wav_request_n, wav_match_n, 100.0 * wav_match_n / nullif(wav_request_n, 0) AS match_share_pct FROM m_monthly_metrics
WHERE provider = 'Все' AND month IS NOT NULL AND accessibility_segment = 'WAV request'""")
def q_match(spark, d):
    return A.match_share(monthly(spark, d))


@register("access_coverage", "provider:str accessibility_segment:str trips arrival_coverage_pct:real boarding_coverage_pct:real", """
SELECT provider, accessibility_segment, trips, 100.0 * arrival_n / trips AS arrival_coverage_pct, 100.0 * boarding_n / trips AS boarding_coverage_pct
FROM m_monthly_metrics WHERE month IS NULL""")
def q_coverage(spark, d):
    return A.coverage(monthly(spark, d))


@register("access_provider_comparison", "provider:str accessibility_segment:str trips arrival_mean_min:real base_fare_per_mile:real share_pct:real", """
SELECT provider, accessibility_segment, trips, arrival_mean_min, base_fare_per_mile, 100.0 * trips / sum(trips) OVER (PARTITION BY provider) AS share_pct
FROM m_monthly_metrics WHERE month IS NULL AND provider <> 'Все'""")
def q_provider(spark, d):
    return A.provider_comparison(monthly(spark, d))


LONG = """(SELECT 'accessibility' AS segment, dow, hour, sum(accessibility_trips) AS trips FROM m_cells GROUP BY 2, 3
  UNION ALL SELECT 'ordinary', dow, hour, sum(ordinary_trips) FROM m_cells GROUP BY 2, 3) g"""


@register("access_weekly_profile", "segment:str dow hour trips share_pct:real",
          f"SELECT segment, dow, hour, trips, 100.0 * trips / sum(trips) OVER (PARTITION BY segment) AS share_pct FROM {LONG}")
def q_profile(spark, d):
    return A.weekly_profile(cells(spark, d))


@register("access_period_shares", "segment:str weekday_9_16_pct:real weekend_pct:real night_0_5_pct:real", f"""
SELECT segment, 100.0 * sum(trips) FILTER (WHERE dow NOT IN (0, 6) AND hour BETWEEN 9 AND 16) / sum(trips) AS weekday_9_16_pct,
  100.0 * sum(trips) FILTER (WHERE dow IN (0, 6)) / sum(trips) AS weekend_pct, 100.0 * sum(trips) FILTER (WHERE hour BETWEEN 0 AND 5) / sum(trips) AS night_0_5_pct
FROM {LONG} GROUP BY 1""")
def q_periods(spark, d):
    return A.period_shares(cells(spark, d))


@register("access_zone_choropleth", "direction:str LocationID zone:str borough:str total_trips accessibility_share_pct:real", """
SELECT m.direction, m.LocationID, z.zone, z.borough, total_trips, accessibility_share_pct FROM m_zone_metrics m LEFT JOIN zones z ON m.LocationID = z.LocationID""")
def q_choropleth(spark, d):
    return A.zone_choropleth(A.zone_metrics(core(spark, d)), T("zones")(spark, d))


@register("access_top_zones", "direction:str LocationID zone:str accessibility_trips", """
SELECT direction, q.LocationID, z.zone, accessibility_trips FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY accessibility_trips DESC, LocationID) AS rn
  FROM m_zone_metrics) q LEFT JOIN zones z ON q.LocationID = z.LocationID WHERE rn <= 10""")
def q_top(spark, d):
    return A.top_zones(A.zone_metrics(core(spark, d)), T("zones")(spark, d))


@register("access_mart_checks", "check:str violations", """
SELECT 'wav_within_ordinary' AS "check", count(*) FILTER (WHERE NOT (ordinary_wav_trips <= ordinary_trips)) AS violations FROM m_cells
UNION ALL SELECT 'parts_sum_to_whole', count(*) FILTER (WHERE NOT (accessibility_trips + ordinary_trips = all_trips)) FROM m_cells
UNION ALL SELECT 'ordinary_parts', count(*) FILTER (WHERE NOT (ordinary_wav_trips + ordinary_nonwav_trips = ordinary_trips)) FROM m_cells""")
def q_checks(spark, d):
    from tripmarts.operators.profile import mart_checks
    return mart_checks(cells(spark, d), {
        "wav_within_ordinary": F.col("ordinary_wav_trips") <= F.col("ordinary_trips"),
        "parts_sum_to_whole": F.col("accessibility_trips") + F.col("ordinary_trips") == F.col("all_trips"),
        "ordinary_parts": F.col("ordinary_wav_trips") + F.col("ordinary_nonwav_trips") == F.col("ordinary_trips")})
