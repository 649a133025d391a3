"""Mart store: a folder of parquet marts with a contract and a build record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmarts import lineage


class MartStore:
    """Marts under `root`. `contract` maps the allowed names to a schema, or to None for any schema."""

    def __init__(self, spark: SparkSession, root: str, contract: dict[str, T.StructType | None]):
        self.spark, self.root, self.contract = spark, root.rstrip("/"), contract

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _check(self, df: DataFrame, name: str) -> None:
        if name not in self.contract:
            raise ValueError(f"mart {name} is not in the contract")
        want = self.contract[name]
        if want is not None:
            have = [(f.name, f.dataType) for f in df.schema.fields]
            if have != [(f.name, f.dataType) for f in want.fields]:
                raise ValueError(f"mart {name} has columns {have}")

    def write(self, df: DataFrame, name: str, grain: list[str] | None = None, description: str = "") -> DataFrame:
        """Replace a mart, check its grain, append a build record (rows, bytes); returns the stored mart.
        Sort order comes from the panels; a mart is written as its last shuffle left it."""
        self._check(df, name)
        if grain:  # checked before the old mart goes
            df = lineage.cut(df)
            twice = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if not twice.isEmpty():
                raise ValueError(f"mart {name} is not unique by {grain}")
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        stored = self.read(name)
        size = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path(name)).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
        record = size.select(F.lit(name).alias("mart"), F.lit(stored.count()).alias("rows"), "bytes", F.lit(description).alias("description"), F.current_timestamp().alias("built_at"))
        record.write.mode("append").parquet(self.path("_records"))
        return stored

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
            return True
        except AnalysisException:
            return False

    def read(self, name: str) -> DataFrame:
        """A stored mart; a clear error when it has not been built."""
        if not self.exists(name):
            raise FileNotFoundError(f"mart {name} has not been built under {self.root}")
        return self.spark.read.parquet(self.path(name))

    def once(self, name: str, build: Callable[[], DataFrame], **kw) -> DataFrame:
        """The stored mart, built only when it is missing."""
        return self.read(name) if self.exists(name) else self.write(build(), name, **kw)

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self.path("_records"))

    def publish(self, name: str, table: str | None = None) -> None:
        """Serving copy as a catalog table."""
        self.read(name).write.mode("overwrite").saveAsTable(table or name)

    def export(self, name: str, path: str, fmt: str = "csv") -> None:
        """Text export of a mart."""
        writer = self.read(name).write.mode("overwrite")
        writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)
