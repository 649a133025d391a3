"""Zone clustering by the shape of the day."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.operators.rollup import pivot_sum, rows
from tripmarts.operators.window import share

#: Starts that are fitted at the same time.
SIDE_BY_SIDE = 8
SLOTS = [f"{p}{h}" for p in ("wd", "we") for h in range(24)]


def profiles(trips: DataFrame, zone: str = "PULocationID", ts: str = "pickup_datetime") -> DataFrame:
    """zone x 48 hourly shares (24 weekday, 24 weekend), absent hours as 0."""
    part = F.when(F.dayofweek(ts).isin(1, 7), "we").otherwise("wd")
    counts = trips.groupBy(F.col(zone).alias("zone"), part.alias("part"), F.hour(ts).alias("hr")).agg(rows().alias("trips"))
    shares = share(counts, "trips", ["zone", "part"], "pct", 1.0).withColumn("slot", F.concat("part", F.col("hr").cast("string")))
    return pivot_sum(shares, ["zone"], "slot", SLOTS, "pct", 0.0)


def vectors(prof: DataFrame) -> DataFrame:
    """Feature vectors, materialised once for all the fits."""
    return lineage.cut(VectorAssembler(inputCols=SLOTS, outputCol="features").transform(prof))


def _fit(data: DataFrame, k: int, seed: int, restarts: int):
    """The cheapest of several starts; their jobs run side by side."""
    one = lambda i: KMeans(k=k, seed=seed + i, maxIter=50, featuresCol="features", predictionCol="cluster").fit(data)
    with ThreadPool(SIDE_BY_SIDE) as pool:
        return min(pool.map(one, range(restarts)), key=lambda m: m.summary.trainingCost)


def _scores(data: DataFrame, ks: range, seed: int, restarts: int) -> list[tuple[int, float]]:
    ev = ClusteringEvaluator(predictionCol="cluster", featuresCol="features")
    return [(k, float(ev.evaluate(_fit(data, k, seed, restarts).transform(data)))) for k in ks]


def silhouettes(data: DataFrame, ks: range = range(3, 10), seed: int = 42, restarts: int = 10) -> DataFrame:
    """Silhouette for each k, best first."""
    return data.sparkSession.createDataFrame(_scores(data, ks, seed, restarts), "k int, silhouette double").orderBy(F.desc("silhouette"))


def assign(data: DataFrame, k: int | None = None, seed: int = 42, restarts: int = 20, ks: range = range(3, 10)) -> DataFrame:
    """Membership with a label taken from the centroid's peak hours, not from the cluster number.

    Without k, the one of `ks` with the best silhouette is taken (the least of equals)."""
    if k is None:
        k = max(_scores(data, ks, seed, restarts // 2), key=lambda x: (x[1], -x[0]))[0]
    member = lineage.cut(_fit(data, k, seed, restarts).transform(data).drop("features"))
    cent = centroids(member)
    peak = lambda p: F.expr(f"array_position(array({', '.join(f'{p}{h}' for h in range(24))}), greatest({', '.join(f'{p}{h}' for h in range(24))})) - 1")
    named = cent.select("cluster", F.concat(F.lit("weekday peak "), peak("wd").cast("string"), F.lit("h, weekend peak "), peak("we").cast("string"), F.lit("h")).alias("cluster_label"))
    return member.join(named, "cluster")


def centroids(member: DataFrame) -> DataFrame:
    return member.groupBy("cluster").agg(rows().alias("n_zones"), *[F.avg(s).alias(s) for s in SLOTS])


def borough_counts(member: DataFrame, zones: DataFrame) -> DataFrame:
    return member.join(zones.select(F.col("LocationID").alias("zone"), "borough"), "zone", "left").groupBy("cluster_label", "borough").agg(rows().alias("n_zones"))
