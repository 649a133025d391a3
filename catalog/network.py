"""Spatial and network queries."""

from pyspark.sql import functions as F

from catalog.base import T, cte, register
from tripmarts import lineage
from tripmarts.operators import network as N
from tripmarts.operators import spatial
from tripmarts.operators.window import rank_bins


def trips(spark, d):
    return T("fhvhv_trips")(spark, d)


@register("polygon_centroids", "ring_id area:real cx:real cy:real", """
SELECT ring_id, abs(a) / 2 AS area, sx / nullif(3 * a, 0) AS cx, sy / nullif(3 * a, 0) AS cy FROM (SELECT ring_id, sum(c) AS a, sum((x + nx) * c) AS sx, sum((y + ny) * c) AS sy FROM (
  SELECT ring_id, x, y, nx, ny, x * ny - nx * y AS c FROM (SELECT ring_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny
    FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq)) q) r GROUP BY 1) s WHERE abs(a) > 0.000001""")
def q_centroids(spark, d):
    return spatial.polygon_centroids(T("rings")(spark, d), "ring_id").where("area > 0.0000005")


cte("od", "SELECT PULocationID AS pu, DOLocationID AS do_, count(*) AS trips FROM fhvhv_trips GROUP BY 1, 2")


@register("od_pairs", "pu do_ trips", "SELECT * FROM od")
def q_od(spark, d):
    return N.od_pairs(trips(spark, d))


@register("intra_zone_share", "trips same_zone same_pct:real", "SELECT sum(trips) AS trips, sum(trips) FILTER (WHERE pu = do_) AS same_zone, 100.0 * sum(trips) FILTER (WHERE pu = do_) / sum(trips) AS same_pct FROM od")
def q_intra(spark, d):
    return N.intra_zone_share(trips(spark, d))


@register("borough_flows", "from_borough:str to_borough:str trips", """
SELECT a.borough AS from_borough, b.borough AS to_borough, sum(trips) AS trips FROM od JOIN zones a ON a.LocationID = pu JOIN zones b ON b.LocationID = do_ GROUP BY 1, 2""")
def q_flows(spark, d):
    return N.borough_flows(trips(spark, d), T("zones")(spark, d))


cte("routes100", "SELECT * FROM od WHERE pu <> do_ ORDER BY trips DESC, pu, do_ LIMIT 100")


@register("top_routes", "pu do_ trips zone_from:str zone_to:str borough_from:str borough_to:str lat_from:real lon_to:real", """
SELECT o.*, a.zone AS zone_from, b.zone AS zone_to, a.borough AS borough_from, b.borough AS borough_to, a.lat AS lat_from, b.lon AS lon_to
FROM (SELECT * FROM routes100 ORDER BY trips DESC, pu, do_ LIMIT 15) o LEFT JOIN zones a ON a.LocationID = pu LEFT JOIN zones b ON b.LocationID = do_""")
def q_routes(spark, d):
    return N.top_routes(trips(spark, d), T("zones")(spark, d), 15)


@register("route_volume_quartiles", "pu do_ trips bin", """
SELECT pu, do_, trips, CAST(greatest(1, ceil((rn - 1) * 4.0 / greatest(n - 1, 1))) AS BIGINT) AS bin FROM (
  SELECT *, row_number() OVER (ORDER BY trips, pu, do_) AS rn, count(*) OVER () AS n FROM routes100) q""")
def q_quartiles(spark, d):
    return rank_bins(N.top_routes(trips(spark, d), T("zones")(spark, d), 100), "trips", 4, ["pu", "do_"])


cte("busiest", """SELECT CASE WHEN hour(pickup_datetime) BETWEEN 7 AND 10 THEN 'morning' WHEN hour(pickup_datetime) BETWEEN 11 AND 15 THEN 'day' WHEN hour(pickup_datetime) BETWEEN 16 AND 18 THEN 'evening' ELSE 'night' END AS period,
  PULocationID AS pu, DOLocationID AS do_, count(*) AS trips FROM fhvhv_trips WHERE PULocationID NOT IN (264, 265) AND DOLocationID NOT IN (264, 265)
  AND CAST(pickup_datetime AS DATE) = (SELECT CAST(pickup_datetime AS DATE) AS d FROM fhvhv_trips GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2, 3""")


@register("busiest_day_flows", "period:str pu do_ trips", "SELECT * FROM busiest")
def q_busiest(spark, d):
    return N.busiest_day_flows(trips(spark, d))


@register("busiest_day_top_flows", "period:str pu do_ trips", "SELECT period, pu, do_, trips FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY trips DESC, pu, do_) AS rn FROM busiest) q WHERE rn <= 5")
def q_busiest_top(spark, d):
    return N.busiest_day_flows(trips(spark, d), 5)


cte("roads", """SELECT way_id, u, v, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2)))) AS length_m, one
FROM (SELECT way_id, node AS u, lead(node) OVER w AS v, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, first(oneway) OVER w AS one FROM (
  SELECT *, CAST(round((lat + 90) * 1e6) AS BIGINT) * 536870912 + CAST(round((lon + 180) * 1e6) AS BIGINT) AS node FROM way_vertices WHERE highway <> 'footway') n
  WINDOW w AS (PARTITION BY way_id ORDER BY seq)) q WHERE v IS NOT NULL AND u <> v""")
cte("road_both", "SELECT way_id, u, v, length_m FROM roads UNION ALL SELECT way_id, v, u, length_m FROM roads WHERE one <> 1")


@register("road_edges", "way_id u v length_m:real", "SELECT * FROM road_both")
def q_roads(spark, d):
    return N.road_edges(T("way_vertices")(spark, d))


@register("road_components", "component nodes")
def q_components(spark, d):
    return N.components(q_roads(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@register("road_largest_component", "way_id u v length_m:real")
def q_largest(spark, d):
    e = lineage.cut(q_roads(spark, d))
    return N.largest_component(e, N.components(e))


def routes(spark, d):
    """Each order's parts in line order, as a route carrying the order's quantity."""
    line = T("lineitem")(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.sum("l_quantity").cast("bigint").alias("q"))
    return line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))), lambda s: s["p"]).alias("nodes"), F.sum("q").alias("trips"))


cte("steps", """SELECT u, v, sum(t) AS load FROM (SELECT p AS u, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS v, sum(q) OVER (PARTITION BY l_orderkey) AS t FROM (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) a) b WHERE v IS NOT NULL GROUP BY 1, 2""")


@register("edge_load", "u v load", "SELECT * FROM steps")
def q_load(spark, d):
    return N.edge_load(routes(spark, d))


cte("und", "SELECT least(u, v) AS a, greatest(u, v) AS b, sum(load) AS load FROM steps GROUP BY 1, 2")


@register("undirected_load_tiers", "a b load tier:str", """
SELECT a, b, load, CASE WHEN load <= max(load) FILTER (WHERE rn - 1 = n // 3) OVER () THEN 'green' WHEN load <= max(load) FILTER (WHERE rn - 1 = 2 * n // 3) OVER () THEN 'amber' ELSE 'red' END AS tier
FROM (SELECT *, row_number() OVER (ORDER BY load, a, b) AS rn, count(*) OVER () AS n FROM und) q""")
def q_tiers(spark, d):
    return N.load_tiers(lineage.cut(N.undirected_load(N.edge_load(routes(spark, d)))))


def od_nodes(spark, d):
    """The 60 largest zone flows of each period of the busiest day, both centroids snapped to the nearest road node."""
    v = T("way_vertices")(spark, d).where("highway <> 'footway'")
    nodes = v.select(N.node_id(F.col("lat"), F.col("lon")).alias("node"), "lat", "lon").distinct()
    snap = spatial.nearest(T("zones")(spark, d), "LocationID", nodes, target_id="node").select("LocationID", "target")
    top = N.busiest_day_flows(trips(spark, d), 60).select("period", "pu", "do_", "trips")
    return lineage.cut(top.join(snap.withColumnsRenamed({"LocationID": "pu", "target": "u"}), "pu", "left").join(snap.withColumnsRenamed({"LocationID": "do_", "target": "v"}), "do_", "left"))


def routed(spark, d):
    od = od_nodes(spark, d)
    snapped = od.where("u IS NOT NULL AND v IS NOT NULL")
    return od, N.shortest_paths(q_roads(spark, d), snapped)


@register("routed_flow_lengths", "period:str pu do_ trips dist_m:real")
def q_routed(spark, d):
    od, best = routed(spark, d)
    return od.join(best.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("dist_m")), ["u", "v"], "left")


@register("routed_flow_counts", "period:str routed failed trips")
def q_routed_counts(spark, d):
    return N.flow_outcomes(*routed(spark, d))


@register("routed_edge_load", "period:str u v load")
def q_routed_load(spark, d):
    od, best = routed(spark, d)
    pairs = od.where("u IS NOT NULL AND v IS NOT NULL").groupBy("u", "v").agg(F.sum("trips").alias("trips"))
    steps = N.route_edges(best, pairs).select(F.col("source").alias("from"), F.col("target").alias("to"), "u", "v")
    flows = od.select("period", F.col("u").alias("from"), F.col("v").alias("to"), "trips")
    return steps.join(flows, ["from", "to"]).groupBy("period", "u", "v").agg(F.sum("trips").alias("load"))
