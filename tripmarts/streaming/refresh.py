"""Incremental refresh: newly landed files are cleaned and folded into additive marts.

Every micro-batch writes its own increment under its batch id, so a replayed batch replaces itself. The
mart is the sum of the increments; medians stay exact because the increments of a wait mart are histograms.

`refresh` folds additive sums and removes copies inside a batch. `HistogramMart` also keeps percentiles and removes copies that land in
different batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmarts import lineage
from tripmarts.operators import clean as C
from tripmarts.operators.quantile import hist_mean, hist_quantile
from tripmarts.operators.rollup import rows


def refresh(spark: SparkSession, landing: str, schema: T.StructType, increment: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
            pattern: str = "*.parquet", files_per_batch: int = 64) -> None:
    """Process all files that are new since the last call, then stop. `increment` maps a batch to additive rows."""
    def save(batch: DataFrame, batch_id: int) -> None:
        increment(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, out: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The mart as of the last refresh."""
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def compact(spark: SparkSession, out: str, target: str, keys: list[str], sums: list[str]) -> None:
    """Fold all increments into one set of files at a new place."""
    current(spark, out, keys, sums).write.mode("overwrite").option("compression", "zstd").parquet(target)


def daily_increment(family: str, years: tuple[int, int] = C.YEARS) -> Callable[[DataFrame], DataFrame]:
    """Clean a batch of high-volume trips and count day x provider sums."""
    from tripmarts.functions import trip as X

    def build(batch: DataFrame) -> DataFrame:
        kept = batch.where(C.predicate(family, years)).distinct()
        return kept.groupBy(X.day_of("pickup_datetime").alias("date"), X.provider().alias("provider")).agg(
            rows().alias("trips"), F.sum("base_passenger_fare").alias("fare"), F.sum("driver_pay").alias("pay"), F.sum("trip_miles").alias("miles"))
    return build


def wait_increment(batch: DataFrame) -> DataFrame:
    """Wait histogram of a batch at the finest grain."""
    from tripmarts.plans.suite import wait_base
    return wait_base(C.wait_trips(batch))


WAIT_KEYS = ["zone", "aggregator", "period", "hr", "dow", "wait_sec"]


class HistogramMart:
    """A mart with percentiles that landings refresh, partition by partition (a month, for instance).

    Three tables lie below `root`, each in folders batch=<id>/<part>=<value>, but for the mart, which has no batches:

    * `seen`: two 64-bit hashes per row. A row of a batch counts only if no earlier batch has its hashes; only the partitions of the batch are read.
    * `increments`: additive histograms by key, part and value (rows, and sums of other columns).
    * `mart`: the measures of each key, computed again for the partitions that a batch touched, from all their increments; other partitions
      are not read or written (dynamic partition overwrite).

    All three are written anew if a batch is replayed, and a batch never reads its own folders or later ones, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, part: str, keys: list[str], value: str, measures: list[Column], sums: list[str] | None = None):
        self.spark, self.root, self.part, self.keys, self.value, self.measures, self.sums = spark, root.rstrip("/"), part, keys, value, measures, sums or []

    def _earlier(self, name: str, batch_id: int, parts: list) -> DataFrame | None:
        """Rows of a table that batches up to batch_id (not included) wrote for some partitions."""
        try:
            table = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # the first batch
            return None
        return table.where((F.col("batch") < batch_id) & F.col(self.part).isin(parts))

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch_id}"
        df.write.mode("overwrite").partitionBy(self.part).option("compression", "zstd").parquet(path)
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(path)

    def add(self, batch: DataFrame, batch_id: int, identity: list[str]) -> None:
        """Fold a batch with the columns part, keys, value, sums and identity (those that make a row the same)."""
        columns = list(dict.fromkeys([self.part, *self.keys, self.value, *self.sums]))
        hashed = batch.select(*columns, *C.row_hashes(identity)).dropDuplicates(["_h1", "_h2", self.part])
        parts = [r[0] for r in hashed.select(self.part).distinct().collect()]  # as many as the calendar has
        if not parts:
            return
        seen = self._earlier("seen", batch_id, parts)
        fresh = hashed if seen is None else hashed.join(seen.select(self.part, "_h1", "_h2"), [self.part, "_h1", "_h2"], "left_anti")
        fresh = lineage.cut(fresh)
        if fresh.isEmpty():  # copies only
            return
        self._write(fresh.select(self.part, "_h1", "_h2"), "seen", batch_id)
        counts = [rows().alias("n"), *[F.sum(c).alias(c) for c in self.sums]]
        grown = self._write(fresh.groupBy(self.part, *self.keys, self.value).agg(*counts), "increments", batch_id)
        touched = [r[0] for r in grown.select(self.part).distinct().collect()]
        self._measure(batch_id, touched)

    def _measure(self, batch_id: int, touched: list) -> None:
        whole = self._earlier("increments", batch_id + 1, touched)
        summed = whole.groupBy(self.part, *self.keys, self.value).agg(*[F.sum(c).alias(c) for c in ("n", *self.sums)])
        mart = summed.groupBy(self.part, *self.keys).agg(*self.measures, *[F.sum(c).alias(c) for c in self.sums]).withColumn("refreshed_by", F.lit(batch_id))
        mart.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).option("compression", "zstd").parquet(f"{self.root}/mart")

    def refresh(self, landing: str, schema: T.StructType, shape: Callable[[DataFrame], DataFrame], identity: list[str], pattern: str = "*.parquet", files_per_batch: int = 64) -> None:
        """Fold all files that are new since the last call, then stop. `shape` cleans a batch and gives it the columns of `add`."""
        stream = self.spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
        query = (stream.writeStream.foreachBatch(lambda batch, i: self.add(shape(batch), i, identity))
                 .option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start())
        query.awaitTermination()

    def read(self) -> DataFrame:
        """The mart as of the last refresh."""
        return self.spark.read.parquet(f"{self.root}/mart")


def wait_measures() -> list[Column]:
    """Measures of a wait histogram."""
    return [F.sum("n").alias("trips"), hist_quantile("wait_sec", .5).alias("med_wait_sec"), hist_quantile("wait_sec", .9).alias("p90_wait_sec"), hist_mean("wait_sec").alias("avg_wait_sec")]


def monthly_waits(batch: DataFrame, years: tuple[int, int] = C.YEARS) -> DataFrame:
    """Valid high-volume trips of a batch with month, provider, zone and wait; all columns of the batch stay."""
    from tripmarts.functions import trip as X

    kept = batch.where(C.predicate("fhvhv", years)).where((F.col("pickup_datetime") > F.col("request_datetime")) & X.known_license())
    return (kept.withColumns({"month": X.month_of("pickup_datetime"), "provider": X.provider(), "zone": F.col("PULocationID"), "wait_sec": X.wait_seconds(),
                              "fare": F.col("base_passenger_fare")}).where("zone IS NOT NULL AND wait_sec < 3600"))
