"""Road network and flows as table jobs: edges, components, routes and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.functions.geo import haversine_m
from tripmarts.operators.rollup import rows, top_n
from tripmarts.operators.window import order_tiers

# Zone ids without a place, and the road classes that are routed.
SENTINEL_ZONES = [264, 265]
MAJOR_ROADS = ["motorway", "trunk", "primary", "secondary", "tertiary"]
MAJOR_ROADS += [f"{c}_link" for c in MAJOR_ROADS]


def od_pairs(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.col("PULocationID").alias("pu"), F.col("DOLocationID").alias("do_")).agg(rows().alias("trips"))


def intra_zone_share(trips: DataFrame) -> DataFrame:
    pairs = od_pairs(trips)
    same = F.sum(F.when(F.col("pu") == F.col("do_"), F.col("trips")).otherwise(0))
    return pairs.agg(F.sum("trips").alias("trips"), same.alias("same_zone")).withColumn("same_pct", F.try_divide(F.col("same_zone") * 100.0, F.col("trips").cast("double")))


def borough_flows(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Flows between boroughs: pairs of zones first, names after."""
    b = zones.select("LocationID", "borough")
    return (od_pairs(trips).join(b.withColumnsRenamed({"LocationID": "pu", "borough": "from_borough"}), "pu")
            .join(b.withColumnsRenamed({"LocationID": "do_", "borough": "to_borough"}), "do_").groupBy("from_borough", "to_borough").agg(F.sum("trips").alias("trips")))


def top_routes(trips: DataFrame, zones: DataFrame, n: int) -> DataFrame:
    """Largest flows between different zones with names and centroids of both ends."""
    top = top_n(od_pairs(trips).where(F.col("pu") != F.col("do_")), n, [F.desc("trips"), F.asc("pu"), F.asc("do_")])
    z = zones.select("LocationID", "zone", "borough", "lat", "lon")
    end = lambda key, s: z.select(F.col("LocationID").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in ("zone", "borough", "lat", "lon")])
    return top.join(end("pu", "from"), "pu", "left").join(end("do_", "to"), "do_", "left")


def busiest_day_flows(trips: DataFrame, n: int | None = None) -> DataFrame:
    """Zone-pair flows by day period on the day with most trips, sentinel zones left out; top n per period."""
    daily = trips.groupBy(X.day_of("pickup_datetime").alias("d")).agg(rows().alias("n"))
    day = daily.agg(F.max_by("d", F.struct("n", F.datediff(F.lit("2100-01-01").cast("date"), "d")))).scalar()
    rows_ = trips.withColumns({"d": X.day_of("pickup_datetime"), "_busiest": day}).where(F.col("d") == F.col("_busiest"))
    rows_ = rows_.where(~F.col("PULocationID").isin(SENTINEL_ZONES) & ~F.col("DOLocationID").isin(SENTINEL_ZONES))
    flows = rows_.groupBy(X.day_period(F.hour("pickup_datetime")).alias("period"), F.col("PULocationID").alias("pu"), F.col("DOLocationID").alias("do_")).agg(rows().alias("trips"))
    return flows if n is None else top_n(flows, n, [F.desc("trips"), F.asc("pu"), F.asc("do_")], ["period"])


def node_id(lat, lon):
    """One id per coordinate rounded to six decimals."""
    y = F.round((lat + 90) * 1e6).cast("bigint")
    x = F.round((lon + 180) * 1e6).cast("bigint")
    return y * F.lit(2 ** 29) + x


def road_edges(vertices: DataFrame) -> DataFrame:
    """Directed segments of ordered way vertices: one per consecutive pair, and its reverse unless one-way.
    A way is one-way when its first vertex says so. Columns: way_id, seq, lat, lon, oneway, highway."""
    w = Window.partitionBy("way_id").orderBy("seq")
    v = vertices.where(F.col("highway").isin(MAJOR_ROADS)).withColumn("node", node_id(F.col("lat"), F.col("lon")))
    seg = v.withColumns({"v": F.lead("node").over(w), "_lat": F.lead("lat").over(w), "_lon": F.lead("lon").over(w), "_one": F.first("oneway").over(w)})
    seg = seg.where("v is not null and v <> node").select("way_id", F.col("node").alias("u"), "v", haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("length_m"), "_one")
    both = F.when(F.col("_one") == 1, F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return seg.select("way_id", F.explode(both).alias("e"), "length_m").select("way_id", "e.u", "e.v", "length_m")


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): weakly connected components, each named by its smallest node.

    Alternates two rewirings, each pointing neighbours at the smallest node they know, which shortens long
    roads by halves rather than one hop per round. Minima are combined before the shuffle and joined back, so
    a hub is never gathered in one place; the join on a hub is split by adaptive execution.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    every = lineage.cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = lineage.cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # Every node tells its larger neighbours about the smallest node around it.
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every node and its smaller neighbours move to the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = lineage.cut(e.where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return every.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges inside the component with most nodes (the smaller name wins a tie)."""
    top = comp.groupBy("component").agg(rows().alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = comp.join(top.select("component"), "component", "left_semi").select(F.col("node").alias("u"))
    return edges.join(keep, "u", "left_semi")


def edge_load(routes: DataFrame, nodes: str = "nodes", trips: str = "trips") -> DataFrame:
    """Trips over every directed step of routes given as node arrays."""
    steps = F.arrays_zip(F.slice(nodes, F.lit(1), F.size(nodes) - 1).alias("u"), F.slice(nodes, F.lit(2), F.size(nodes) - 1).alias("v"))
    ok = routes.where(F.size(nodes) > 1)
    return ok.select(F.explode(steps).alias("s"), trips).select("s.u", "s.v", trips).groupBy("u", "v").agg(F.sum(trips).alias("load"))


def undirected_load(load: DataFrame) -> DataFrame:
    return load.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("load").alias("load"))


def load_tiers(load: DataFrame) -> DataFrame:
    """green / amber / red by the order statistics at n/3 and 2n/3."""
    return order_tiers(load, "load", ["a", "b"], ["green", "amber", "red"])


def shortest_paths(edges: DataFrame, od: DataFrame, max_rounds: int = 10000) -> DataFrame:
    """(source, node, dist, prev) of all nodes on a shortest route of a pair of `od` (u, v, ...), and of every source.

    Both ends of a pair are searched at once, one edge a round: labels are kept per (side, root, node), where the root is a source,
    or a target from which edges are followed against their direction. A node with labels of both ends gives a route; only nodes within
    half of the longest route still known for a root are extended. That is enough: on the shortest route, the last node within
    half of it is extended by the source, and the target has an exact label of the next one. So labels grow with two half
    circles a pair, and not with all nodes a source. A pair without a route ends when one side has nothing new.
    """
    folder = lineage.shared_folder(od.sparkSession, "paths")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return lineage.stored(df, f"{folder}/{name}")

    never = F.lit(float("inf"))
    ends = od.select(F.col("u").alias("source"), F.col("v").alias("target")).where("source is not null and target is not null").distinct()
    same = F.col("source") == F.col("target")
    pairs = stored(ends.select("source", "target", F.when(same, 0.0).otherwise(never).alias("best"), F.lit(0).alias("hops"), F.when(same, F.col("source")).alias("meet")), "pairs0")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node"), F.col("v").alias("next")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node"), F.col("u").alias("next")))
    arcs = edges.groupBy("u", "v").agg(F.min("length_m").alias("length_m")).select(F.explode(sides).alias("a"), "length_m")
    arcs = stored(arcs.select("a.side", "a.node", "a.next", "length_m"), "arcs")
    roots = F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("root")), F.struct(F.lit(1).alias("side"), F.col("target").alias("root")))
    start = pairs.select(F.explode(roots).alias("r")).select("r.side", "r.root").distinct()
    labels = stored(start.select("side", "root", F.col("root").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("prev")), "labels0")
    for n in range(1, max_rounds + 1):
        far = stored(pairs.select(F.explode(roots).alias("r"), "best").groupBy("r.side", "r.root").agg(F.max("best").alias("far")), f"far{n}")
        # The slack is for sums taken from either end, which differ by rounding.
        front = labels.where(F.col("at") == n - 1).join(far, ["side", "root"]).where(F.col("dist") <= F.col("far") * (0.5 + 1e-9))
        front = stored(front.select("side", "root", "node", "dist"), f"front{n}")
        if front.isEmpty():
            break
        step = front.join(arcs, ["side", "node"]).select("side", "root", F.col("next").alias("node"), (F.col("dist") + F.col("length_m")).alias("dist"), F.lit(n).alias("at"), F.col("node").alias("prev"))
        least = labels.unionByName(step).groupBy("side", "root", "node").agg(F.min(F.struct("dist", "at", "prev")).alias("l"))
        labels = stored(least.select("side", "root", "node", "l.*").join(far, ["side", "root"]).where(F.col("dist") <= F.col("far") * (1 + 1e-9)).drop("far"), f"labels{n}")
        pairs = stored(_meetings(pairs, labels, n), f"pairs{n}")
    else:
        raise RuntimeError("paths did not settle")
    rows_ = _chains(pairs.where(F.col("best") < never), labels, f"{folder}/walked", max_rounds).unionByName(
        ends.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("prev")))
    # Where routes of a source meet, all take the same way there.
    return stored(rows_.groupBy("source", "node").agg(F.min(F.struct("dist", "hops", "prev")).alias("l")).select("source", "node", "l.dist", "l.prev"), "paths")


def _meetings(pairs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The shortest route known for each pair and where its ends meet; pairs that can have none are left out."""
    one = labels.where("side = 0").select(F.col("root").alias("source"), "node", F.col("dist").alias("d0"), F.col("at").alias("a0"))
    other = labels.where("side = 1").select(F.col("root").alias("target"), "node", F.col("dist").alias("d1"), F.col("at").alias("a1"))
    met = one.join(pairs.select("source", "target"), "source").join(other, ["target", "node"])
    met = met.groupBy("source", "target").agg(F.min(F.struct((F.col("d0") + F.col("d1")).alias("best"), (F.col("a0") + F.col("a1")).alias("hops"), F.col("node").alias("meet"))).alias("m"))
    fresh = labels.where(F.col("at") == n).select("side", "root").distinct()
    alive = [fresh.where(f"side = {k}").select(F.col("root").alias(end), F.lit(True).alias(f"new_{end}")) for k, end in enumerate(("source", "target"))]
    known = pairs.select("source", "target").join(met, ["source", "target"], "left").join(alive[0], "source", "left").join(alive[1], "target", "left")
    return (known.where("m is not null or (new_source and new_target)")
            .select("source", "target", F.coalesce("m.best", F.lit(float("inf"))).alias("best"), F.coalesce("m.hops", F.lit(0)).alias("hops"), F.col("m.meet").alias("meet")))


def _chains(pairs: DataFrame, labels: DataFrame, folder: str, max_rounds: int) -> DataFrame:
    """(source, node, dist, hops, prev) along each pair's route, walked from the meeting node to both ends."""
    halves = F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("root"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("hops")),
                     F.struct(F.lit(1).alias("side"), F.col("target").alias("root"), F.col("best"), F.col("hops")))
    at = pairs.select("source", F.explode(halves).alias("h"), "meet").select("source", "h.*", F.col("meet").alias("node"), F.lit(None).cast("bigint").alias("came")).distinct()
    for n in range(max_rounds):
        seen = lineage.stored(at.join(labels, ["side", "root", "node"]), f"{folder}/step={n}")
        if seen.isEmpty():
            break
        at = seen.where("prev is not null").select("source", "side", "root", "best", "hops", F.col("prev").alias("node"), F.col("node").alias("came")).distinct()
    else:
        raise RuntimeError("routes did not end")
    seen = pairs.sparkSession.read.schema(seen.schema).parquet(folder)
    ahead = seen.where("side = 0").select("source", "node", "dist", F.col("at").alias("hops"), "prev")
    return ahead.unionByName(seen.where("side = 1 and came is not null").select(
        "source", "node", (F.col("best") - F.col("dist")).alias("dist"), (F.col("hops") - F.col("at")).alias("hops"), F.col("came").alias("prev")))


def route_edges(paths: DataFrame, od: DataFrame, max_rounds: int = 10000) -> DataFrame:
    """(source, target, trips, u, v): the steps of each pair's shortest path, walked back from the target."""
    at = od.select(F.col("u").alias("source"), F.col("v").alias("target"), "trips").where("source <> target").withColumn("node", F.col("target"))
    at = lineage.cut(at.join(paths.select("source", "node"), ["source", "node"], "left_semi").select("source", "target", "trips", "node"))
    folder, walked = lineage.shared_folder(od.sparkSession, "routes"), False
    for _ in range(max_rounds):
        step = lineage.cut(at.join(paths.select("source", "node", "prev").where("prev is not null"), ["source", "node"]))
        if step.isEmpty():
            break
        step.select("source", "target", "trips", F.col("prev").alias("u"), F.col("node").alias("v")).write.mode("append").parquet(folder)
        walked = True
        at = step.select("source", "target", "trips", F.col("prev").alias("node"))
    else:
        raise RuntimeError("routes did not end")
    if not walked:
        return at.select("source", "target", "trips", F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    return od.sparkSession.read.parquet(folder)


def flow_outcomes(flows: DataFrame, paths: DataFrame) -> DataFrame:
    """Per period: flows with a route, flows without one (an end without a road node, or no way), trips of all flows.

    A flow within one road node needs no route and counts as neither."""
    done = flows.join(paths.select(F.col("source").alias("u"), F.col("node").alias("v"), "dist"), ["u", "v"], "left")
    apart = F.coalesce(F.col("u") != F.col("v"), F.lit(True))
    return done.groupBy("period").agg(F.count_if(F.col("dist").isNotNull() & apart).alias("routed"), F.count_if(F.col("dist").isNull()).alias("failed"), F.sum("trips").alias("trips"))


def load_of_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("u", "v").agg(F.sum("trips").alias("load"))
