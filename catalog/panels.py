"""Panel queries over marts."""

from pyspark.sql import functions as F

from catalog import events, overview, suite
from catalog.base import T, cte, register
from tripmarts.operators import clean as C
from tripmarts.plans import overview as O
from tripmarts.plans import panels as P
from tripmarts.plans import suite as M


class Lazy(dict):
    """Marts built on first use, so a panel plans only what it reads."""

    def __init__(self, spark, d):
        super().__init__()
        tr = overview.trips
        self._build = {
            "aggregator_monthly": lambda: suite.aggregator_monthly(spark, d), "product_metrics_yearly": lambda: suite.product_metrics(spark, d),
            "wait_by_hour_dow_aggregator": lambda: M.wait_by_hour_dow(suite.base(spark, d), True),
            "zone_wait_by_aggregator": lambda: M.zone_wait_by_aggregator(suite.base(spark, d)), "zone_wait_time": lambda: M.zone_wait_time(suite.base(spark, d)),
            "zone_access": lambda: events.q_access(spark, d), "zone_dominant_type": lambda: suite.zone_dominant_type(spark, d),
            "zone_dominant_aggregator": lambda: suite.zone_dominant_aggregator(spark, d), "monthly_by_type": lambda: suite.monthly_by_type(spark, d),
            "monthly_by_type_indexed": lambda: suite.monthly_by_type_indexed(spark, d), "monthly_recovery_indexed": lambda: suite.recovery(spark, d),
            "yearly_recovery_indexed": lambda: M.yearly_recovery(suite.recovery(spark, d)), "aggregator_by_borough": lambda: suite.aggregator_by_borough(spark, d),
            "event_impact": lambda: events.impact(spark, d), "event_hypothesis": lambda: events.hypothesis(spark, d),
            "event_hypothesis_venue": lambda: events.q_hyp_venue(spark, d), "trips_daily": lambda: O.trips_daily(tr(spark, d)),
            "trips_monthly_provider": lambda: O.trips_monthly_provider(tr(spark, d)), "trips_by_zone": lambda: overview.q_by_zone(spark, d),
            "trips_by_zone_daily": lambda: overview.q_by_zone_daily(spark, d), "trips_by_zone_do": lambda: overview.q_by_zone_do(spark, d),
            "trips_hourly_dow_daily": lambda: O.trips_hourly_dow_daily(tr(spark, d)), "weather_daily": lambda: T("weather")(spark, d),
            "zone_centroids": lambda: T("zones")(spark, d), "mart_segment_daily": lambda: O.mart_segment_daily(C.complete_trips(tr(spark, d))),
            "wait_hourly_provider": lambda: O.wait_hourly_provider(C.complete_trips(tr(spark, d))), "mile_bin_pricing": lambda: O.mile_bin_pricing(C.complete_trips(tr(spark, d)))}

    def __missing__(self, name):
        self[name] = self._build[name]()
        return self[name]


def reg(name, spec, sql, _key=None, **params):
    register(_key or f"panel_{name}", spec, sql)(lambda spark, d: P.panel(name, Lazy(spark, d), **params))


cte("m_zone_access", """SELECT z.LocationID, z.zone, z.borough, dist_m, annual_trips, avg_trip_miles, fare_per_mile FROM zones z JOIN zone_distance q ON z.LocationID = q.LocationID
JOIN (SELECT PULocationID, count(*) AS annual_trips, avg(trip_miles) AS avg_trip_miles, sum(base_passenger_fare) / nullif(sum(trip_miles), 0) AS fare_per_mile
  FROM fhvhv_trips WHERE year(pickup_datetime) = 1996 GROUP BY 1) v ON v.PULocationID = z.LocationID""")
cte("m_type_indexed", """SELECT month, taxi_type, trips, 100.0 * trips / max(CASE WHEN month = DATE '1996-01-01' THEN trips END) OVER (PARTITION BY taxi_type) AS index_base_100 FROM m_monthly_by_type""")
cte("m_yearly_recovery", "SELECT year(month) AS year, series, avg(index_base_100) AS index_base_100, sum(trips) AS trips FROM m_recovery GROUP BY 1, 2")
cte("m_hyp_venue", """SELECT venue_id, venue_name, price_tier, dist_m, count(*) AS n_events, median(post_pu_lift_pct) AS post_pu_lift FROM m_event_hyp WHERE dist_m IS NOT NULL GROUP BY 1, 2, 3, 4""")

reg("yearly_provider_share", "time:date aggregator:str share_pct:real", """
SELECT make_date(CAST(y AS INTEGER), 1, 1) AS time, aggregator, 100.0 * n / sum(n) OVER (PARTITION BY y) AS share_pct
FROM (SELECT year(month) AS y, aggregator, sum(trips) AS n FROM m_aggregator_monthly GROUP BY 1, 2) q QUALIFY aggregator = 'Uber'""")
reg("yearly_kpis", "time:date avg_daily_trips:real med_wait_min:real med_hourly_pay:real med_fare_per_mile:real avg_trips_per_active_zone_hour:real", f"""
SELECT make_date(CAST(n.year AS INTEGER), 1, 1) AS time, avg_daily_trips, med_wait_sec / 60 AS med_wait_min, med_hourly_pay, med_fare_per_mile, avg_trips_per_active_zone_hour
FROM (SELECT year(pickup_datetime) AS year, 1.0 * count(*) / count(DISTINCT CAST(pickup_datetime AS DATE)) AS avg_daily_trips FROM all_trips GROUP BY 1) n
JOIN ({suite.PAY}) p ON n.year = p.year JOIN ({suite.FPM}) f ON n.year = f.year JOIN ({suite.LIQ}) l ON n.year = l.year WHERE n.year IN (1996, 1997, 1998)""", years=[1996, 1997, 1998])
reg("wait_heatmap", "hour " + " ".join(f"{x}:real" for x in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")), "SELECT hour, " + ", ".join(
    f"sum(med_wait_sec * n_trips) FILTER (WHERE dow = {i}) / nullif(sum(n_trips) FILTER (WHERE dow = {i}), 0) / 60 AS {x}"
    for i, x in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))) + " FROM m_hour_dow_agg WHERE aggregator IN ('Uber', 'Lyft') GROUP BY 1", aggregators=["Uber", "Lyft"])
reg("provider_wait", "Uber:real Lyft:real Via:real Juno:real", "SELECT " + ", ".join(
    f"sum(med_wait_sec * n_trips) FILTER (WHERE aggregator = '{p}') / nullif(sum(n_trips) FILTER (WHERE aggregator = '{p}'), 0) / 60 AS {p}" for p in ("Uber", "Lyft", "Via", "Juno"))
    + " FROM m_zone_wait_agg WHERE n_trips >= 20", min_n=20)
reg("worst_wait_zones", "zone_name:str med_wait_min:real", """
SELECT a.zone AS zone_name, sum(med_wait_sec * n_trips) / nullif(sum(n_trips), 0) / 60 AS med_wait_min FROM m_zone_wait_agg w JOIN m_zone_access a ON a.LocationID = w.zone
JOIN m_dominant_type t ON t.zone = w.zone WHERE n_trips >= 20 GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15""", min_n=20)
reg("zones_by_type", "zone zone_name:str dominant_type:str dominant_share_pct:real", """
SELECT zone, zone_name, dominant_type, dominant_share_pct FROM m_dominant_type WHERE dominant_type IN ('fhvhv', 'fhv') ORDER BY dominant_share_pct DESC, zone LIMIT 30""", types=["fhvhv", "fhv"])
reg("airport_table", "zone:str annual_trips med_wait_min:real fare_per_mile:real", """
SELECT a.zone, annual_trips, w.m / 60 AS med_wait_min, fare_per_mile FROM m_zone_access a LEFT JOIN (SELECT zone, median(wait_sec) AS m FROM waits GROUP BY 1) w ON w.zone = a.LocationID
WHERE LocationID IN (132, 138)""", airports=[132, 138])
reg("recovery_pct", "taxi_type:str recovery_pct:real", """
SELECT taxi_type, 100.0 * sum(trips) FILTER (WHERE year(month) = 1998) / nullif(sum(trips) FILTER (WHERE year(month) = 1996), 0) AS recovery_pct FROM m_monthly_by_type GROUP BY 1""", base=1996, year=1998)
reg("index_series", "time:date series:str index_base_100:real", """
SELECT month AS time, taxi_type AS series, index_base_100 FROM m_type_indexed WHERE taxi_type IN ('yellow', 'fhvhv')
UNION ALL SELECT month, series, index_base_100 FROM m_recovery WHERE series = 'transit'""", types=["yellow", "fhvhv"])
reg("recovery_series", "time:date series:str recovery_idx:real", """
SELECT month AS time, series, index_base_100 AS recovery_idx FROM m_recovery WHERE series IN ('transit', 'ASIA', 'EUROPE')""", boroughs=["ASIA", "EUROPE"])
reg("recovery_series", "time:date series:str recovery_idx:real", """
SELECT make_date(CAST(year AS INTEGER), 1, 1) AS time, series, index_base_100 AS recovery_idx FROM m_yearly_recovery""", _key="panel_recovery_series_yearly", yearly=True)
reg("trough", "taxi_type:str min_index_pct:real bottom_month:date", """
SELECT taxi_type, min(index_base_100) AS min_index_pct, (array_agg(month ORDER BY index_base_100, month))[1] AS bottom_month FROM m_type_indexed
WHERE month < DATE '1998-01-01' AND index_base_100 IS NOT NULL GROUP BY 1""", before="1998-01-01")
reg("provider_share_by_borough", "borough:str Uber:real Lyft:real", """
SELECT borough, max(CASE WHEN aggregator = 'Uber' THEN share_pct END) AS Uber, max(CASE WHEN aggregator = 'Lyft' THEN share_pct END) AS Lyft FROM m_provider_borough
WHERE borough IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1""", boroughs=["ASIA", "EUROPE", "AFRICA"])
reg("zone_counts", "dominant:str n_zones", "SELECT dominant_type AS dominant, count(*) AS n_zones FROM m_dominant_type GROUP BY 1")
reg("zone_counts", "dominant:str n_zones", "SELECT dominant_aggregator AS dominant, count(*) AS n_zones FROM m_dominant_agg GROUP BY 1", _key="panel_zone_counts_provider", by="dominant_aggregator")
reg("dominance_exceptions", "zone_name:str borough:str dominant:str dominant_share_pct:real", """
SELECT zone_name, borough, dominant_aggregator AS dominant, dominant_share_pct FROM m_dominant_agg WHERE dominant_aggregator <> 'Uber'
UNION ALL SELECT zone_name, borough, dominant_type, dominant_share_pct FROM m_dominant_type WHERE dominant_type <> 'fhvhv'""")
reg("event_kpis", "avg_post_pu:real avg_pre_do:real n_events price_lift_r:real", """
SELECT avg(post_pu_lift_pct) AS avg_post_pu, avg(pre_do_lift_pct) AS avg_pre_do, count(*) AS n_events, (SELECT corr(price_tier, post_pu_lift_pct) FROM m_event_hyp) AS price_lift_r
FROM m_event_impact WHERE event_type IN ('Concert', 'League')""", event_types=["Concert", "League"])
reg("lift_by_tier", "tier:str post_pu_lift:real", "SELECT CAST(price_tier AS VARCHAR) AS tier, median(post_pu_lift) AS post_pu_lift FROM m_hyp_venue GROUP BY 1")
reg("lift_by_type", "event_type:str post_pu_lift:real pre_do_lift:real", """
SELECT event_type, quantile_cont(post_pu_lift_pct, .5) AS post_pu_lift, quantile_cont(pre_do_lift_pct, .5) AS pre_do_lift FROM m_event_impact GROUP BY 1""")
reg("top_events", "event:str lift_pct:real", """
SELECT left(title, 40) || ' (' || CAST(date AS VARCHAR) || ')' AS event, post_pu_lift_pct AS lift_pct FROM m_event_impact ORDER BY 2 DESC, 1 LIMIT 20""")
reg("event_table", "date:date event_type:str title:str venue_name:str price_tier dist_m:real pre_do_lift_pct:real post_pu_lift_pct:real", """
SELECT date, event_type, title, venue_name, price_tier, dist_m, pre_do_lift_pct, post_pu_lift_pct FROM m_event_hyp WHERE event_type IN ('Concert', 'League')
ORDER BY post_pu_lift_pct DESC, date, title LIMIT 30""", event_types=["Concert", "League"])
K = ["trips", "pay_sum", "base_passenger_fare_sum", "commission"]
reg("kpis_yoy", "month:date trips pay_sum:real base_passenger_fare_sum:real commission:real " + " ".join(f"{c}_yoy_pct:real" for c in K), f"""
SELECT a.*, {', '.join(f"100 * (1.0 * a.{c} / nullif(b.{c}, 0) - 1) AS {c}_yoy_pct" for c in K)}
FROM m_kpi a LEFT JOIN m_kpi b ON b.month = CAST(a.month - INTERVAL '12' MONTH AS DATE)""".replace("m_kpi", """(SELECT CAST(date_trunc('month', date) AS DATE) AS month,
  sum(trips) AS trips, sum(pay_sum) AS pay_sum, sum(base_passenger_fare_sum) AS base_passenger_fare_sum, sum(base_passenger_fare_sum) - sum(pay_sum) AS commission
  FROM m_trips_daily WHERE provider IN ('Uber', 'Lyft') GROUP BY 1)"""), providers=["Uber", "Lyft"])
reg("bookings_ytd", "month:date bookings:real ytd:real ytd_yoy_pct:real", """
SELECT a.*, 100 * (a.ytd / b.ytd - 1) AS ytd_yoy_pct FROM m_ytd a LEFT JOIN m_ytd b ON b.month = CAST(a.month - INTERVAL '12' MONTH AS DATE)""".replace("m_ytd", """
(SELECT month, bookings, sum(bookings) OVER (PARTITION BY year(month) ORDER BY month) AS ytd FROM (SELECT month, sum(bookings) AS bookings FROM m_monthly_provider GROUP BY 1) q)"""))
reg("daily_by_provider", "date:date provider:str trips fare:real pay:real commission:real share_pct:real", """
SELECT date, provider, trips, base_passenger_fare_sum AS fare, pay_sum AS pay, base_passenger_fare_sum - pay_sum AS commission, 100.0 * trips / sum(trips) OVER (PARTITION BY date) AS share_pct
FROM m_trips_daily WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'""", dates=("1996-03-01", "1997-02-28"))
reg("top_pickup_zones", "LocationID zone:str trips", "SELECT LocationID, zone, sum(trips) AS trips FROM m_by_zone_daily GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20")
reg("hour_dow", "dow " + " ".join(f"h{h}" for h in range(24)), "SELECT dayofweek(pickup_datetime) AS dow, " + ", ".join(
    f"count(*) FILTER (WHERE hour(pickup_datetime) = {h}) AS h{h}" for h in range(24)) + " FROM fhvhv_trips WHERE CAST(pickup_datetime AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1",
    dates=("1996-01-01", "1996-12-31"))
reg("take_rate_by_month", "month:date take_rate_pct:real", "SELECT month, 100 * (1 - sum(pay_sum) / nullif(sum(fare_sum), 0)) AS take_rate_pct FROM m_monthly_provider GROUP BY 1")
reg("per_mile_and_hour", "month:date revenue_per_mile:real pay_per_mile:real driver_hourly:real", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(base_passenger_fare_sum) / nullif(sum(miles_sum), 0) AS revenue_per_mile, sum(pay_sum) / nullif(sum(miles_sum), 0) AS pay_per_mile,
  3600 * sum(pay_sum) / nullif(sum(time_sum), 0) AS driver_hourly FROM m_trips_daily GROUP BY 1""")
reg("airports_vs_rest", "area:str trips avg_fare:real driver_hourly:real", """
SELECT CASE WHEN LocationID IN (132, 138) THEN 'airports' ELSE 'rest' END AS area, sum(trips) AS trips, sum(fare_sum) / sum(trips) AS avg_fare, 3600 * sum(pay_sum) / sum(time_sum) AS driver_hourly
FROM m_by_zone GROUP BY 1""", airports=[132, 138])
reg("revenue_concentration", "top_fare:real top_share_pct:real", """
SELECT sum(fare) AS top_fare, 100 * sum(fare) / (SELECT sum(fare_sum) FROM m_by_zone) AS top_share_pct FROM (
  SELECT LocationID, sum(fare_sum) AS fare FROM m_by_zone GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) q""")
reg("weather_correlations", "rain_trips_r:real temp_fare_r:real", """
SELECT corr(prcp_mm, trips) AS rain_trips_r, corr(tmax_c, fare / trips) AS temp_fare_r FROM (SELECT date, sum(trips) AS trips, sum(base_passenger_fare_sum) AS fare FROM m_trips_daily GROUP BY 1) q
JOIN weather w ON w.date = q.date""")
for _end, _src in (("pickup", "m_by_zone"), ("dropoff", "m_by_zone_do")):
    reg("driver_hourly_map", "LocationID driver_hourly:real trips lat:real lon:real", f"""
SELECT q.*, z.lat, z.lon FROM (SELECT LocationID, 3600 * sum(pay_sum) / nullif(sum(time_sum), 0) AS driver_hourly, sum(trips) AS trips FROM {_src} GROUP BY 1) q
JOIN zones z ON z.LocationID = q.LocationID""", _key=f"panel_driver_hourly_{_end}", end=_end)
reg("fee_breakdown", "fee:str amount:real share_pct:real", "SELECT fee, amount, 100 * amount / sum(amount) OVER () AS share_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS fee, sum({c}_sum) AS amount FROM m_trips_daily WHERE provider IN ('Uber', 'Lyft')" for c in overview.FEES) + ") q", providers=["Uber", "Lyft"])
reg("bookings_share", "month:date provider:str bookings:real share_pct:real", "SELECT month, provider, bookings, 100 * bookings / sum(bookings) OVER (PARTITION BY month) AS share_pct FROM m_monthly_provider")
reg("ride_types", "provider:str segment:str trips take:real take_pct:real", """
SELECT provider, segment, sum(trips) AS trips, sum(take) AS take, 100 * sum(take) / nullif(sum(fare), 0) AS take_pct FROM m_segment_daily GROUP BY 1, 2""")
for _key, _k in (("panel_wait_gap", "wait_group"), ("panel_wait_gap_by_hour", "wait_group, hour")):
    reg("wait_gap", "wait_group:str" + (" hour" if "hour" in _key else "") + " uber:real lyft:real gap_sec:real", f"""
SELECT *, lyft - uber AS gap_sec FROM (SELECT {_k}, avg(w) FILTER (WHERE provider = 'Uber') AS uber, avg(w) FILTER (WHERE provider = 'Lyft') AS lyft FROM m_wait_long GROUP BY {_k}) q""",
        _key=_key, by_hour="hour" in _key)
reg("distance_pricing", "provider:str mile_bin:str mile_bin_order take_rate_pct:real fare_per_mile:real", "SELECT * FROM m_mile_bins WHERE provider IN ('Uber', 'Lyft')", providers=["Uber", "Lyft"])


@register("filter_values", "kind:str value:str", """
SELECT DISTINCT 'borough' AS kind, borough AS value FROM m_daily_by_borough UNION ALL SELECT DISTINCT 'taxi_type', taxi_type FROM m_monthly_by_type
UNION ALL SELECT DISTINCT 'aggregator', aggregator FROM m_aggregator_monthly""")
def q_filters(spark, d):
    m = Lazy(spark, d)
    parts = [(suite.by_borough(spark, d), "borough"), (m["monthly_by_type"], "taxi_type"), (m["aggregator_monthly"], "aggregator")]
    out = None
    for df, c in parts:
        one = P.filter_values(df, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
