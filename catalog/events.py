"""Event-window queries."""

from catalog.base import T, cte, register
from tripmarts.operators import spatial
from tripmarts.plans import events as E

HAV = ("2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(s.lat) - radians(z.lat)) / 2), 2) + cos(radians(z.lat)) * cos(radians(s.lat)) "
       "* pow(sin((radians(s.lon) - radians(z.lon)) / 2), 2))))")
cte("zone_distance", f"SELECT z.LocationID, min({HAV}) AS dist_m FROM zones z CROSS JOIN stations s GROUP BY 1")
cte("bridge", """SELECT DISTINCT venue_id, zone FROM (SELECT venue_id, primary_zone AS zone FROM venues
  UNION ALL SELECT venue_id, CAST(trim(unnest(string_split(buffer_zones, ','))) AS BIGINT) FROM venues) q""")
cte("zone_hours", """SELECT coalesce(p.d, q.d) AS d, coalesce(p.hr, q.hr) AS hr, coalesce(p.dow, q.dow) AS dow, coalesce(p.zone, q.zone) AS zone,
  coalesce(p.n, 0) AS pu_trips, coalesce(q.n, 0) AS do_trips FROM (
  SELECT CAST(pickup_datetime AS DATE) AS d, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, PULocationID AS zone, count(*) AS n
  FROM fhvhv_trips WHERE PULocationID IN (SELECT zone FROM bridge) GROUP BY 1, 2, 3, 4) p
FULL OUTER JOIN (SELECT CAST(pickup_datetime AS DATE) AS d, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, DOLocationID AS zone, count(*) AS n
  FROM fhvhv_trips WHERE DOLocationID IN (SELECT zone FROM bridge) GROUP BY 1, 2, 3, 4) q ON p.d = q.d AND p.hr = q.hr AND p.dow = q.dow AND p.zone = q.zone""")
cte("event_windows", """SELECT e.date, e.venue_id, e.event_type, e.title, e.start_hour, w.name AS win, e.start_hour + w.a AS h0, e.start_hour + w.b AS h1
FROM event_calendar e CROSS JOIN (VALUES ('pre', -2, 0), ('event', 0, 3), ('post', 3, 5)) AS w(name, a, b)
WHERE e.date IN (SELECT d FROM zone_hours)""")
# Every hour also as hour + 24 of the day before.
cte("zone_hours_spill", """SELECT d, hr, dow, zone, pu_trips, do_trips FROM zone_hours
UNION ALL SELECT CAST(d - INTERVAL '1' DAY AS DATE), hr + 24, (dow + 6) % 7, zone, pu_trips, do_trips FROM zone_hours""")
OBSERVED = """SELECT w.date, w.venue_id, w.title, w.win, coalesce(sum(h.pu_trips), 0) AS pu, coalesce(sum(h.do_trips), 0) AS do_
FROM event_windows w JOIN bridge b ON w.venue_id = b.venue_id LEFT JOIN {hours} h ON h.zone = b.zone AND h.d = w.date AND h.hr >= w.h0 AND h.hr < w.h1
GROUP BY 1, 2, 3, 4"""
cte("event_observed", OBSERVED.format(hours="zone_hours"))
cte("event_observed_spill", OBSERVED.format(hours="zone_hours_spill"))


def _baseline(own, hours="zone_hours"):
    return f"""SELECT date, venue_id, title, win, greatest(avg(pu), 1.0) AS pu, greatest(avg(do_), 1.0) AS do_ FROM (
  SELECT w.date, w.venue_id, w.title, w.win, h.d, sum(h.pu_trips) AS pu, sum(h.do_trips) AS do_
  FROM event_windows w JOIN bridge b ON w.venue_id = b.venue_id JOIN {hours} h ON h.zone = b.zone AND h.dow = dayofweek(w.date) AND h.hr >= w.h0 AND h.hr < w.h1
  WHERE {own} GROUP BY 1, 2, 3, 4, 5) q GROUP BY 1, 2, 3, 4"""


cte("event_baseline", _baseline("(h.d = w.date OR h.d NOT IN (SELECT date FROM event_calendar))"))
cte("event_baseline_spill", _baseline("(h.d = w.date OR h.d NOT IN (SELECT date FROM event_calendar))", "zone_hours_spill"))
cte("event_baseline_other", _baseline("h.d NOT IN (SELECT date FROM event_calendar)"))


def _impact(base, observed="event_observed"):
    lifts = ", ".join(f"max(CASE WHEN w.win = '{w}' THEN 100.0 * (o.{c} / coalesce(b.{c}, 1.0) - 1) END) AS {w}_{s}_lift_pct"
                      for w in ("pre", "event", "post") for c, s in (("pu", "pu"), ("do_", "do")))
    return f"""SELECT w.date, w.venue_id, w.event_type, w.title, w.start_hour, {lifts},
  max(CASE WHEN w.win = 'post' THEN o.pu END) AS post_pu_trips, max(CASE WHEN w.win = 'post' THEN o.do_ END) AS post_do_trips
FROM event_windows w JOIN {observed} o ON w.date = o.date AND w.venue_id = o.venue_id AND w.title = o.title AND w.win = o.win
LEFT JOIN {base} b ON w.date = b.date AND w.venue_id = b.venue_id AND w.title = b.title AND w.win = b.win GROUP BY 1, 2, 3, 4, 5"""


cte("m_event_impact", _impact("event_baseline"))
cte("m_event_hyp", """SELECT i.*, v.name AS venue_name, v.price_tier, z.dist_m, ln(1 + coalesce(z.dist_m, 500.0)) AS log_dist_m
FROM m_event_impact i LEFT JOIN venues v ON i.venue_id = v.venue_id LEFT JOIN zone_distance z ON v.primary_zone = z.LocationID""")
IMPACT = ("date:date venue_id:str event_type:str title:str start_hour " + " ".join(f"{w}_{s}_lift_pct:real" for w in ("pre", "event", "post") for s in ("pu", "do"))
          + " post_pu_trips post_do_trips")


def parts(spark, d):
    return T("event_calendar")(spark, d), T("venues")(spark, d), T("fhvhv_trips")(spark, d)


def impact(spark, d):
    return E.event_impact(*parts(spark, d))


def distances(spark, d):
    return spatial.nearest(T("zones")(spark, d), "LocationID", T("stations")(spark, d))


def hypothesis(spark, d):
    return E.event_hypothesis(impact(spark, d), T("venues")(spark, d), distances(spark, d))


@register("venue_zone_hourly", "d:date hr dow zone pu_trips do_trips", "SELECT * FROM zone_hours")
def q_hourly(spark, d):
    return E.zone_hourly(T("fhvhv_trips")(spark, d), E.venue_zones(T("venues")(spark, d)))


@register("event_impact", IMPACT, "SELECT * FROM m_event_impact")
def q_impact(spark, d):
    return impact(spark, d)


@register("event_impact_without_own_day", IMPACT, _impact("event_baseline_other"))
def q_impact_other(spark, d):
    return E.event_impact(*parts(spark, d), exclude_self=True)


@register("event_impact_across_midnight", IMPACT, _impact("event_baseline_spill", "event_observed_spill"))
def q_midnight(spark, d):
    return E.event_impact(*parts(spark, d), cross_midnight=True)


@register("event_impact_by_type", "event_type:str n_events avg_pre_do_lift:real avg_post_pu_lift:real avg_event_pu_lift:real median_post_pu_lift:real", """
SELECT event_type, count(*) AS n_events, avg(pre_do_lift_pct) AS avg_pre_do_lift, avg(post_pu_lift_pct) AS avg_post_pu_lift,
  avg(event_pu_lift_pct) AS avg_event_pu_lift, median(post_pu_lift_pct) AS median_post_pu_lift FROM m_event_impact GROUP BY 1""")
def q_by_type(spark, d):
    return E.impact_by_type(impact(spark, d))


@register("dashboard_events", "event_time:ts title:str tags:str", """
SELECT CAST(date AS TIMESTAMP) + start_hour * INTERVAL '1' HOUR AS event_time, title, lower(event_type) AS tags FROM event_calendar""")
def q_ann(spark, d):
    return E.annotations(T("event_calendar")(spark, d))


@register("event_hypothesis", "date:date venue_id:str title:str venue_name:str price_tier dist_m:real log_dist_m:real post_pu_lift_pct:real pre_do_lift_pct:real", "SELECT * FROM m_event_hyp")
def q_hyp(spark, d):
    return hypothesis(spark, d)


@register("event_hypothesis_venue", "venue_id:str venue_name:str price_tier dist_m:real n_events post_pu_lift:real pre_do_lift:real post_pu_avg:real", """
SELECT venue_id, venue_name, price_tier, dist_m, count(*) AS n_events, median(post_pu_lift_pct) AS post_pu_lift, median(pre_do_lift_pct) AS pre_do_lift,
  avg(post_pu_lift_pct) AS post_pu_avg FROM m_event_hyp WHERE dist_m IS NOT NULL GROUP BY 1, 2, 3, 4""")
def q_hyp_venue(spark, d):
    return E.hypothesis_by_venue(hypothesis(spark, d))


cte("m_lapse_rows", """SELECT b.venue_id, h.zone, h.d, h.hr, h.dow, h.pu_trips AS trips, e.date IS NOT NULL AS is_event
FROM zone_hours h JOIN bridge b ON h.zone = b.zone LEFT JOIN (SELECT DISTINCT venue_id, date FROM event_calendar) e ON e.venue_id = b.venue_id AND e.date = h.d WHERE h.pu_trips > 0""")
cte("m_lapse", """SELECT coalesce(e.venue_id, b.venue_id) AS venue_id, coalesce(e.hr, b.hr) AS hr, coalesce(e.zone, b.zone) AS zone, coalesce(evt, 0) AS evt, coalesce(base, 0) AS base,
  CASE WHEN base > 0 THEN coalesce(evt, 0) / base ELSE 0 END AS lift
FROM (SELECT venue_id, hr, zone, avg(trips) AS evt FROM m_lapse_rows WHERE is_event GROUP BY 1, 2, 3) e
FULL OUTER JOIN (SELECT venue_id, hr, zone, avg(base) AS base FROM (SELECT venue_id, hr, zone, dow, avg(trips) AS base FROM m_lapse_rows WHERE NOT is_event GROUP BY 1, 2, 3, 4) q
  WHERE (venue_id, dow) IN (SELECT (venue_id, dow) FROM m_lapse_rows WHERE is_event) GROUP BY 1, 2, 3) b ON e.venue_id = b.venue_id AND e.hr = b.hr AND e.zone = b.zone""")


@register("event_timelapse", "venue_id:str hr zone evt:real base:real lift:real", "SELECT * FROM m_lapse")
def q_lapse(spark, d):
    ev, ve, tr = parts(spark, d)
    return E.event_timelapse(tr, ev, ve)


@register("event_timelapse_domain", "venue_id:str lo:real hi:real", """
SELECT venue_id, lo, CASE WHEN hi <= lo THEN lo + 1 ELSE hi END AS hi FROM (
  SELECT venue_id, quantile_cont(evt, .08) AS lo, quantile_cont(evt, .92) AS hi FROM m_lapse WHERE evt > 0 GROUP BY 1) q""")
def q_lapse_domain(spark, d):
    ev, ve, tr = parts(spark, d)
    return E.timelapse_domain(E.event_timelapse(tr, ev, ve))


cte("wait_rows", """SELECT b.venue_id, CAST(request_datetime AS DATE) AS d, hour(request_datetime) AS hr, dayofweek(request_datetime) AS dow, zone,
  date_diff('second', request_datetime, pickup_datetime) AS w, e.date IS NOT NULL AS is_event
FROM fhvhv_trips f JOIN bridge b ON f.PULocationID = b.zone LEFT JOIN (SELECT DISTINCT venue_id, date FROM event_calendar) e
  ON e.venue_id = b.venue_id AND e.date = CAST(request_datetime AS DATE)
WHERE pickup_datetime > request_datetime AND date_diff('second', request_datetime, pickup_datetime) < 3600""")
cte("pickup_days", """SELECT b.venue_id, CAST(pickup_datetime AS DATE) AS d, hour(pickup_datetime) AS hr, dayofweek(pickup_datetime) AS dow, count(*) AS n
FROM fhvhv_trips f JOIN bridge b ON f.PULocationID = b.zone GROUP BY 1, 2, 3, 4""")


@register("event_case_hours", "venue_id:str date:date hr n avg_wait_sec:real med_wait_sec:real pickups:real base_avg_wait_sec:real base_med_wait_sec:real base_n:real base_pickups:real", """
SELECT e.venue_id, e.d AS date, e.hr, e.n, e.avg_wait_sec, e.med_wait_sec, p.n AS pickups, b.a AS base_avg_wait_sec, b.m AS base_med_wait_sec, b.n AS base_n, q.n AS base_pickups
FROM (SELECT venue_id, d, dow, hr, count(*) AS n, avg(w) AS avg_wait_sec, median(w) AS med_wait_sec FROM wait_rows WHERE is_event GROUP BY 1, 2, 3, 4) e
LEFT JOIN pickup_days p ON p.venue_id = e.venue_id AND p.d = e.d AND p.hr = e.hr
LEFT JOIN (SELECT venue_id, dow, hr, avg(w) AS a, median(w) AS m, count(*) AS n FROM wait_rows WHERE NOT is_event GROUP BY 1, 2, 3) b ON b.venue_id = e.venue_id AND b.dow = e.dow AND b.hr = e.hr
LEFT JOIN (SELECT p.venue_id, dow, hr, avg(n) AS n FROM pickup_days p LEFT JOIN (SELECT DISTINCT venue_id, date FROM event_calendar) c ON c.venue_id = p.venue_id AND c.date = p.d
  WHERE c.date IS NULL GROUP BY 1, 2, 3) q ON q.venue_id = e.venue_id AND q.dow = e.dow AND q.hr = e.hr""")
def q_case(spark, d):
    ev, ve, tr = parts(spark, d)
    return E.event_case(tr, ev, ve)


@register("event_zone_delta", "venue_id:str zone date:date n med_wait_sec:real base_med_wait_sec:real delta_min:real", """
SELECT e.venue_id, e.zone, e.d AS date, e.n, e.m AS med_wait_sec, b.m AS base_med_wait_sec, (e.m - b.m) / 60 AS delta_min
FROM (SELECT venue_id, zone, d, dow, count(*) AS n, median(w) AS m FROM wait_rows WHERE is_event AND hr IN (22, 23) GROUP BY 1, 2, 3, 4) e
JOIN (SELECT venue_id, zone, dow, median(w) AS m FROM wait_rows WHERE NOT is_event AND hr IN (22, 23) GROUP BY 1, 2, 3) b
  ON b.venue_id = e.venue_id AND b.zone = e.zone AND b.dow = e.dow WHERE b.m > 0""")
def q_zone_delta(spark, d):
    ev, ve, tr = parts(spark, d)
    return E.event_zone_delta(tr, ev, ve)


@register("event_wait_vs_baseline", "date:date venue_id:str event_type:str title:str start_hour post_pu_trips post_pu_lift_pct:real avg_wait_sec:real med_wait_sec:real n_wait "
          "base_avg_wait_sec:real base_med_wait_sec:real base_n avg_delta_min:real med_delta_min:real avg_lift_pct:real med_lift_pct:real", """
SELECT i.date, i.venue_id, i.event_type, i.title, i.start_hour, i.post_pu_trips, i.post_pu_lift_pct, e.a AS avg_wait_sec, e.m AS med_wait_sec, e.n AS n_wait,
  b.a AS base_avg_wait_sec, b.m AS base_med_wait_sec, b.n AS base_n, (e.a - b.a) / 60 AS avg_delta_min, (e.m - b.m) / 60 AS med_delta_min,
  100 * (e.a / b.a - 1) AS avg_lift_pct, 100 * (e.m / b.m - 1) AS med_lift_pct
FROM m_event_impact i
JOIN (SELECT c.date, c.venue_id, c.title, avg(w) AS a, median(w) AS m, count(*) AS n FROM event_calendar c JOIN wait_rows r ON r.venue_id = c.venue_id AND r.d = c.date
  AND r.hr >= c.start_hour + 3 AND r.hr < c.start_hour + 5 GROUP BY 1, 2, 3) e ON e.date = i.date AND e.venue_id = i.venue_id AND e.title = i.title
JOIN (SELECT c.date, c.venue_id, c.title, avg(w) AS a, median(w) AS m, count(*) AS n FROM event_calendar c JOIN wait_rows r ON r.venue_id = c.venue_id AND r.dow = dayofweek(c.date)
  AND r.hr >= c.start_hour + 3 AND r.hr < c.start_hour + 5 WHERE NOT r.is_event GROUP BY 1, 2, 3) b ON b.date = i.date AND b.venue_id = i.venue_id AND b.title = i.title""")
def q_wait(spark, d):
    ev, ve, tr = parts(spark, d)
    return E.event_wait_vs_baseline(tr, ev, ve, impact(spark, d))


@register("zone_station_distance", "LocationID dist_m:real", "SELECT * FROM zone_distance")
def q_distance(spark, d):
    return distances(spark, d)


@register("customer_station_distance", "point dist_m:real", f"""
SELECT z.point, min({HAV}) AS dist_m FROM (SELECT c_custkey AS point, 40.5 + (c_custkey * 53 % 1000) * 0.0004 AS lat, -74.2 + (c_custkey * 71 % 1000) * 0.0005 AS lon FROM customer) z
CROSS JOIN stations s GROUP BY 1""")
def q_points(spark, d):
    from pyspark.sql import functions as F
    k = F.col("c_custkey")
    pts = T("customer")(spark, d).select(k.alias("point"), (F.lit(40.5) + (k * 53 % 1000) * F.lit(0.0004)).alias("lat"), (F.lit(-74.2) + (k * 71 % 1000) * F.lit(0.0005)).alias("lon"))
    return spatial.nearest(pts, "point", T("stations")(spark, d))


@register("zone_access", "LocationID zone:str borough:str dist_m:real annual_trips avg_trip_miles:real fare_per_mile:real", """
SELECT z.LocationID, z.zone, z.borough, dist_m, annual_trips, avg_trip_miles, fare_per_mile FROM zones z JOIN zone_distance q ON z.LocationID = q.LocationID
JOIN (SELECT PULocationID, count(*) AS annual_trips, avg(trip_miles) AS avg_trip_miles, sum(base_passenger_fare) / nullif(sum(trip_miles), 0) AS fare_per_mile
  FROM fhvhv_trips WHERE year(pickup_datetime) = 1996 GROUP BY 1) v ON v.PULocationID = z.LocationID WHERE z.borough <> 'EWR'""")
def q_access(spark, d):
    from tripmarts.plans import suite as M
    z = T("zones")(spark, d)
    named = z.select("LocationID", "zone", "borough").join(distances(spark, d), "LocationID").where("borough <> 'EWR'")
    return M.zone_access(T("fhvhv_trips")(spark, d), named, 1996)
