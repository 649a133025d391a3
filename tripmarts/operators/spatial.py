"""Table-based spatial operators: centroids and exact nearest neighbours by a growing grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions.geo import EARTH_RADIUS_M, haversine_m

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def polygon_centroids(vertices: DataFrame, key: str, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Area centroid of each ring by the shoelace sums; vertices are ordered by `seq` and the ring closes itself."""
    w = Window.partitionBy(key).orderBy(seq)
    first = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead(x).over(w), F.first(x).over(first))
    ny = F.coalesce(F.lead(y).over(w), F.first(y).over(first))
    edges = vertices.withColumns({"_nx": nx, "_ny": ny}).withColumn("_cross", F.col(x) * F.col("_ny") - F.col("_nx") * F.col(y))
    twice = F.sum("_cross")
    return edges.groupBy(key).agg(
        (F.abs(twice) / 2).alias("area"), F.try_divide(F.sum((F.col(x) + F.col("_nx")) * F.col("_cross")), twice * 3).alias("cx"),
        F.try_divide(F.sum((F.col(y) + F.col("_ny")) * F.col("_cross")), twice * 3).alias("cy"))


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("bigint")


def nearest(points: DataFrame, key: str, targets: DataFrame, target_id: str | None = None, start_deg: float = 0.005, growth: int = 4) -> DataFrame:
    """Distance in metres from each point to the nearest target (and its id; the smaller id wins a tie),
    exact and without pairing everything.

    A point meets the targets of its 3 x 3 cells. Every other target is at least one cell away, so a hit
    inside that distance is final. Points without one go to a coarser grid, where few are left.
    """
    tid = F.col(target_id) if target_id else F.lit(0)
    places = targets.groupBy(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).agg(F.min(tid).alias("t_id"))
    found = [key, "dist_m"] + (["target"] if target_id else [])
    waiting = points.select(key, "lat", "lon")
    done, size = None, start_deg
    while True:
        around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(
            F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("_cy") + i).alias("gy"), (F.col("_cx") + j).alias("gx"))))))
        asked = (waiting.withColumns({"_cy": _cell("lat", size), "_cx": _cell("lon", size)}).select(key, "lat", "lon", around.alias("g"))
                 .select(key, "lat", "lon", "g.gy", "g.gx"))
        grid = places.withColumns({"gy": _cell("t_lat", size), "gx": _cell("t_lon", size)})
        d = haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
        hits = asked.join(grid, ["gy", "gx"]).groupBy(key).agg(F.min(F.struct(d.alias("dist_m"), F.col("t_id").alias("target"))).alias("_hit")).select(key, "_hit.*")
        # Shortest possible way out of the 3 x 3 block: one cell of longitude at the outer latitude, with slack for the curve.
        outer = F.least(F.abs(F.col("lat")) + 2 * size, F.lit(89.0))
        safe = F.lit(0.98 * size * METRES_PER_DEGREE) * F.cos(F.radians(outer))
        last = size >= 360
        tried = lineage.cut(waiting.join(hits, key, "left").withColumn("_final", F.lit(last) | F.coalesce(F.col("dist_m") <= safe, F.lit(False))))
        final = tried.where("_final").select(*found)
        done = final if done is None else done.unionByName(final)
        waiting = tried.where("not _final").select(key, "lat", "lon")
        if last or waiting.isEmpty():
            return done
        size *= growth


def with_nearest(points: DataFrame, key: str, targets: DataFrame, **kw) -> DataFrame:
    return points.join(nearest(points, key, targets, **kw), key, "left")
