"""Joins, windows, set operations, feeds and streams not covered by a mart."""

from pyspark.sql import functions as F

from catalog import events, suite
from catalog.base import T, cte, register
from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators import dims as D
from tripmarts.operators import window as W
from tripmarts.operators.rollup import pivot_sum, rows, top_n
from tripmarts.plans import events as E
from tripmarts.plans import suite as M
from tripmarts.sources import feeds as FD
from tripmarts.sources import readers as RD
from tripmarts.streaming import refresh as ST


def trips(spark, d):
    return T("fhvhv_trips")(spark, d)


@register("trips_with_zone_names", "l_orderkey l_linenumber zone:str borough:str", "SELECT l_orderkey, l_linenumber, z.zone, z.borough FROM fhvhv_trips f JOIN zones z ON z.LocationID = f.PULocationID")
def q_named(spark, d):
    t = trips(spark, d).select("l_orderkey", "l_linenumber", "PULocationID")
    return D.with_zone(t, T("zones")(spark, d), "PULocationID")


@register("dropoff_counts_unmapped_kept", "DOLocationID trips borough:str", """
SELECT q.*, z.borough FROM (SELECT DOLocationID, count(*) AS trips FROM fhvhv_trips GROUP BY 1) q LEFT JOIN zones z ON z.LocationID = q.DOLocationID""")
def q_unmapped(spark, d):
    counts = trips(spark, d).groupBy("DOLocationID").agg(rows().alias("trips"))
    return D.with_zone(counts, T("zones")(spark, d), "DOLocationID", "left")


@register("zone_metric_star", "zone zone_name:str med_wait_sec:real dominant_type:str dominant_aggregator:str trips:real", """
SELECT z.LocationID AS zone, z.zone AS zone_name, w.m AS med_wait_sec, t.dominant_type, a.dominant_aggregator, coalesce(v.n, 0) AS trips FROM zones z
LEFT JOIN (SELECT zone, median(wait_sec) AS m FROM waits GROUP BY 1) w ON w.zone = z.LocationID LEFT JOIN m_dominant_type t ON t.zone = z.LocationID
LEFT JOIN m_dominant_agg a ON a.zone = z.LocationID LEFT JOIN (SELECT PULocationID AS zone, count(*) AS n FROM fhvhv_trips GROUP BY 1) v ON v.zone = z.LocationID""")
def q_star(spark, d):
    base = T("zones")(spark, d).select(F.col("LocationID").alias("zone"), F.col("zone").alias("zone_name"))
    vol = trips(spark, d).groupBy(F.col("PULocationID").alias("zone")).agg(rows().cast("double").alias("trips"))
    return D.star(base, "zone", [M.zone_wait_time(suite.base(spark, d)).select("zone", "med_wait_sec"), suite.zone_dominant_type(spark, d).select("zone", "dominant_type"),
                                 suite.zone_dominant_aggregator(spark, d).select("zone", "dominant_aggregator"), vol]).fillna(0.0, ["trips"])


@register("daily_series_joined", "date:date trips prcp_mm:real subway crz_entries", """
SELECT q.date, trips, prcp_mm, subway, crz_entries FROM (SELECT CAST(pickup_datetime AS DATE) AS date, count(*) AS trips FROM fhvhv_trips GROUP BY 1) q
JOIN weather w ON w.date = q.date JOIN transit t ON t.date = q.date""")
def q_series(spark, d):
    daily = trips(spark, d).groupBy(X.day_of("pickup_datetime").alias("date")).agg(rows().alias("trips"))
    return D.star(daily, "date", [T("weather")(spark, d).select("date", "prcp_mm"), T("transit")(spark, d)], "inner")


@register("trips_at_venue_zones", "l_orderkey l_linenumber PULocationID", "SELECT l_orderkey, l_linenumber, PULocationID FROM fhvhv_trips WHERE PULocationID IN (SELECT zone FROM bridge)")
def q_semi(spark, d):
    z = E.venue_zones(T("venues")(spark, d)).select(F.col("zone").alias("PULocationID"))
    return D.inside(trips(spark, d), z, "PULocationID")


@register("days_without_events", "date:date trips", "SELECT CAST(pickup_datetime AS DATE) AS date, count(*) AS trips FROM fhvhv_trips WHERE CAST(pickup_datetime AS DATE) NOT IN (SELECT date FROM event_calendar) GROUP BY 1")
def q_anti(spark, d):
    daily = trips(spark, d).groupBy(X.day_of("pickup_datetime").alias("date")).agg(rows().alias("trips"))
    return D.outside(daily, T("event_calendar")(spark, d).select("date"), "date")


@register("pickups_and_dropoffs_by_zone", "zone pickups dropoffs", """
SELECT coalesce(p.zone, q.zone) AS zone, coalesce(p.n, 0) AS pickups, coalesce(q.n, 0) AS dropoffs FROM (SELECT PULocationID AS zone, count(*) AS n FROM fhvhv_trips GROUP BY 1) p
FULL OUTER JOIN (SELECT DOLocationID AS zone, count(*) AS n FROM fhvhv_trips GROUP BY 1) q ON p.zone = q.zone""")
def q_full(spark, d):
    p = trips(spark, d).groupBy(F.col("PULocationID").alias("zone")).agg(rows().alias("pickups"))
    q = trips(spark, d).groupBy(F.col("DOLocationID").alias("zone")).agg(rows().alias("dropoffs"))
    return D.outer_fill(p, q, ["zone"])


@register("event_panel", "date:date venue_id:str title:str price_tier dist_m:real prcp_mm:real tmax_c:real", """
SELECT i.date, i.venue_id, i.title, i.price_tier, i.dist_m, w.prcp_mm, w.tmax_c FROM m_event_hyp i LEFT JOIN weather w ON w.date = i.date""")
def q_event_panel(spark, d):
    return events.hypothesis(spark, d).join(T("weather")(spark, d), "date", "left")


@register("transit_modes_wide", "date:date subway crz_entries", "SELECT date, subway, crz_entries FROM transit")
def q_modes(spark, d):
    long = T("transit")(spark, d).unpivot(["date"], ["subway", "crz_entries"], "mode", "riders")
    return pivot_sum(long, ["date"], "mode", ["subway", "crz_entries"], "riders")


@register("daily_counts", "date:date trips", "SELECT CAST(tpep_pickup_datetime AS DATE) AS date, count(*) AS trips FROM yellow_trips GROUP BY 1")
def q_daily(spark, d):
    return T("yellow_trips")(spark, d).groupBy(X.day_of("tpep_pickup_datetime").alias("date")).agg(rows().alias("trips"))


@register("two_way_demeaned_panel", "zone year y:real", """
SELECT zone, year, y1 - avg(y1) OVER (PARTITION BY year) AS y FROM (SELECT zone, year, log_yellow - avg(log_yellow) OVER (PARTITION BY zone) AS y1 FROM zone_panel) q""")
def q_demean(spark, d):
    return W.demean(suite.zone_year_panel(spark, d), ["log_yellow"], [["zone"], ["year"]]).withColumnRenamed("log_yellow_dm", "y")


@register("rolling_daily_trips", "taxi_type:str date:date trips ma7:real prev1 prev7", """
SELECT taxi_type, date, trips, CASE WHEN count(*) OVER r = 7 THEN avg(trips) OVER r END AS ma7, coalesce(lag(trips, 1) OVER w, 0) AS prev1, coalesce(lag(trips, 7) OVER w, 0) AS prev7 FROM (
  SELECT taxi_type, CAST(pickup_datetime AS DATE) AS date, count(*) AS trips FROM all_trips GROUP BY 1, 2) q
WINDOW w AS (PARTITION BY taxi_type ORDER BY date), r AS (PARTITION BY taxi_type ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_rolling(spark, d):
    daily = suite.all_trips(spark, d).groupBy("taxi_type", X.day_of("pickup_datetime").alias("date")).agg(rows().alias("trips"))
    w = W.Window.partitionBy("taxi_type").orderBy("date")
    return daily.withColumns({"ma7": W.rolling_mean("trips", ["taxi_type"], "date", 7), "prev1": F.coalesce(F.lag("trips", 1).over(w), F.lit(0)), "prev7": F.coalesce(F.lag("trips", 7).over(w), F.lit(0))})


for _side, _c in (("pickup", "PULocationID"), ("dropoff", "DOLocationID")):
    register(f"top10_{_side}_zones", "zone trips", f"SELECT {_c} AS zone, count(*) AS trips FROM fhvhv_trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
        lambda spark, d, c=_c: top_n(trips(spark, d).groupBy(F.col(c).alias("zone")).agg(rows().alias("trips")), 10, [F.desc("trips"), F.asc("zone")]))


@register("monthly_metric_year_before", "month:date provider:str trips trips_prev", """
SELECT a.month, a.provider, a.trips, coalesce(b.trips, 0) AS trips_prev FROM m_monthly_provider a LEFT JOIN m_monthly_provider b ON b.provider = a.provider AND b.month = CAST(a.month - INTERVAL '12' MONTH AS DATE)""")
def q_year_before(spark, d):
    from tripmarts.plans import overview as O
    return W.year_before(O.trips_monthly_provider(trips(spark, d)), ["provider"], "month", ["trips"]).fillna(0, ["trips_prev"])


# --- feeds -------------------------------------------------------------------------------------------------------

def schedule_payload(spark, d):
    """Schedule documents of a day, built from the orders: customers are teams."""
    o = T("orders")(spark, d)
    team = lambda k: F.struct(F.struct(k.alias("id"), F.concat(F.lit("T"), k.cast("string")).alias("name")).alias("team"))
    game = F.struct(F.date_format(F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"),
                    F.when(F.col("o_orderkey") % 9 == 0, "P").otherwise("R").alias("gameType"),
                    F.struct(team(F.col("o_custkey") % 30).alias("home"), team(F.col("o_orderkey") % 30).alias("away")).alias("teams"))
    # At most 64 order keys share a document, so no document grows with the data.
    games = o.groupBy(F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_orderkey") / 64).alias("doc")).agg(F.collect_list(game).alias("games"))
    return games.select(F.to_json(F.struct(F.array(F.struct("games")).alias("dates"))).alias("payload"))


cte("feed", """SELECT CAST(loc AS DATE) AS date, hour(loc) AS start_hour, CASE home WHEN 7 THEN 'yankee' ELSE 'citi' END AS venue_id, 'MLB' AS event_type,
  concat('T', CAST(away AS VARCHAR), ' @ T', CAST(home AS VARCHAR), CASE WHEN post THEN ' (POST)' ELSE '' END) AS title, 'sports,mlb' AS tags FROM (
  SELECT CAST(timezone('America/New_York', timezone('UTC', CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND)) AS TIMESTAMP) AS loc,
    o_custkey % 30 AS home, o_orderkey % 30 AS away, o_orderkey % 9 = 0 AS post FROM orders WHERE o_custkey % 30 IN (7, 21)) q""")
FEED = "date:date start_hour venue_id:str event_type:str title:str tags:str"


def schedule(spark, d):
    return FD.schedule_games(schedule_payload(spark, d), "payload", {7: "yankee", 21: "citi"}, "MLB", "sports,mlb")


@register("feed_schedule_games", FEED, "SELECT * FROM feed")
def q_schedule(spark, d):
    return schedule(spark, d)


def league(spark, d):
    o = T("orders")(spark, d)
    g = o.select(F.to_date("o_orderdate").cast("string").alias("gameday"), F.when(F.col("o_orderkey") % 4 != 0, F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":05"))).alias("gametime"),
                 (F.col("o_custkey") % 50).cast("string").alias("home_team"), (F.col("o_orderkey") % 50).cast("string").alias("away_team"),
                 F.when(F.col("o_orderkey") % 7 == 0, "PRE").otherwise("REG").alias("game_type"))
    return FD.league_games(g, ["3", "4"], (1996, 1998), ["REG", "POST"], "metlife", "NFL", 13, "sports,nfl")


cte("league", """SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 24 ELSE 13 END AS start_hour, 'metlife' AS venue_id, 'NFL' AS event_type,
  concat(CAST(o_orderkey % 50 AS VARCHAR), ' @ ', CAST(o_custkey % 50 AS VARCHAR)) AS title, 'sports,nfl' AS tags FROM orders
WHERE o_custkey % 50 IN (3, 4) AND year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 7 <> 0""")


@register("feed_league_games", FEED, "SELECT * FROM league")
def q_league(spark, d):
    return league(spark, d)


@register("feed_combined_calendar", FEED, """
SELECT date, start_hour, venue_id, event_type, title, tags FROM (SELECT *, row_number() OVER (PARTITION BY date, venue_id, title ORDER BY f, start_hour, event_type, tags) AS rn FROM (
  SELECT *, 0 AS f FROM league UNION ALL SELECT *, 1 FROM feed UNION ALL SELECT date, 20, venue_id, event_type, title, 'concerts', 2 FROM event_calendar) u) r WHERE rn = 1""")
def q_combined(spark, d):
    hand = FD.curated(T("event_calendar")(spark, d).drop("start_hour"), 20, "concerts")
    return FD.combine([league(spark, d), schedule(spark, d), hand])


@register("station_map_source", "station_id:str station_name:str lat:real lon:real", "SELECT CAST(station_id AS VARCHAR) AS station_id, station_name, lat, lon FROM stations")
def q_stations(spark, d):
    s = T("stations")(spark, d)
    entry = F.struct(F.col("station_id").cast("string").alias("key"), F.array(F.col("lat").cast("string"), F.col("lon").cast("string"), "station_name").alias("value"))
    docs = s.groupBy(F.floor(F.col("station_id") / 50).alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return RD.parse_stations(docs, "payload")


@register("sampled_trips_by_hash", "o_orderkey", """
SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('sample-' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1""")
def q_fraction(spark, d):
    return RD.sample_fraction(T("orders")(spark, d), "o_orderkey", 0.1)


@register("sampled_rows_by_hash", "o_orderkey", """
SELECT o_orderkey FROM orders ORDER BY CAST('0x' || substr(md5('sample-' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT), o_orderkey LIMIT 500""")
def q_sample(spark, d):
    return RD.sample_rows(T("orders")(spark, d), "o_orderkey", 500)


@register("stream_refreshed_daily_orders", "date:date orders amount:real", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders, sum(o_totalprice) AS amount FROM orders GROUP BY 1")
def q_stream(spark, d):
    out, ck = lineage.shared_folder(spark, "mart"), lineage.shared_folder(spark, "progress")
    inc = lambda b: b.groupBy(F.to_date("o_orderdate").alias("date")).agg(rows().alias("orders"), F.sum("o_totalprice").alias("amount"))
    ST.refresh(spark, d, T("orders")(spark, d).schema, inc, out, ck, pattern="orders.parquet")
    return ST.current(spark, out, ["date"], ["orders", "amount"])


