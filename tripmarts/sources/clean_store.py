"""Clean twins of raw sources on disk: backfill of what has no valid twin, and cleaning again until every twin passes the rules.

A source is a file or folder `raw/<family>/<name>`, or `raw/<family>/source=<name>` where `partitioned`; its twin is the folder `clean/<family>/source=<name>`. Which twins are valid is read from
their footers in tasks. Twins are replaced one by one by dynamic partition overwrite, so a lost job leaves old or new twins and no mixture.

Equal rows of a source are kept once. Only 128-bit hashes of the rows are shuffled to find those that occur again; whole rows are shuffled just
for these. Hashes that occur again are broadcast while there are few (counted first); beyond that, whole rows are grouped by source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmarts import lineage
from tripmarts.operators import clean as C
from tripmarts.sources import readers
from tripmarts.sources.footers import footers

#: Hashes of repeated rows that are broadcast, 24 bytes each; with more, whole rows are shuffled.
BROADCAST_HASHES = 2_000_000


def once_per_source(rows: DataFrame, source: str = "source") -> DataFrame:
    """Equal rows of a source once."""
    columns = rows.columns
    hashed = rows.select("*", *C.row_hashes([c for c in columns if c != source]))
    again = lineage.cut(hashed.groupBy(source, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    n = again.count()
    if n == 0:
        return rows
    if n > BROADCAST_HASHES:
        return rows.distinct()
    keys = [source, "_h1", "_h2"]
    single = hashed.join(F.broadcast(again), keys, "left_anti").select(*columns)
    repeated = hashed.join(F.broadcast(again), keys, "left_semi").select(*columns).distinct()
    return single.unionByName(repeated.hint("rebalance", source))


class CleanStore:
    """The clean store of one family."""

    def __init__(self, spark: SparkSession, raw_root: str, clean_root: str, family: str, years: tuple[int, int] = C.YEARS, partitioned: bool = False):
        self.spark, self.family, self.years, self.prefix = spark, family, years, "source=" if partitioned else ""
        self.raw, self.clean = f"{raw_root.rstrip('/')}/{family}", f"{clean_root.rstrip('/')}/{family}"

    def _files(self, root: str) -> DataFrame:
        try:
            found = footers(self.spark, root)
        except AnalysisException:  # nothing has been written yet
            found = self.spark.createDataFrame([], "path string, length long, status string, rows long, columns string")
        below = F.regexp_replace(F.col("path"), "^.*/" + self.family + "/", "")
        return found.withColumn("source", F.regexp_replace(F.split(below, "/")[0], "^source=", ""))

    def sources(self) -> DataFrame:
        """source, files, rows and ready (all its files can be read)."""
        return self._by_source(self.raw)

    def twins(self) -> DataFrame:
        """The same for the clean twins: one that isn't ready is damaged."""
        return self._by_source(self.clean)

    def _by_source(self, root: str) -> DataFrame:
        return self._files(root).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.bool_and(F.col("status") == "readable").alias("ready"))

    def pending(self) -> DataFrame:
        """Sources that can be read and have no valid twin."""
        return self.sources().where("ready").select("source").join(self.twins().where("ready").select("source"), "source", "left_anti")

    def read_raw(self, sources: list[str]) -> DataFrame:
        """Rows of some sources, in the columns of the family, with their source."""
        rows = readers.read_family(self.spark, self.family, *[f"{self.raw}/{self.prefix}{s}" for s in sources], source=True)
        below = F.regexp_replace("source_file", "^.*/" + self.family + "/", "")
        return rows.withColumn("source", F.regexp_replace(F.split(below, "/")[0], "^" + self.prefix, "")).drop("source_file")

    def clean_sources(self, sources: list[str]) -> None:
        """(Re)write the twins of some sources."""
        if not sources:
            return
        kept = once_per_source(self.read_raw(sources).where(C.predicate(self.family, self.years)))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source").parquet(self.clean)

    def read(self) -> DataFrame:
        """All twins, with their source (a string, also where names look like numbers)."""
        fields = readers.FAMILIES[self.family].fields
        return self.spark.read.schema(T.StructType([*fields, T.StructField("source", T.StringType())])).parquet(self.clean)

    def validate(self) -> DataFrame:
        """Rows, violations and unknown rows per twin."""
        return C.validate(self.read(), self.family, ["source"], self.years)

    def backfill(self) -> list[str]:
        """Clean all pending sources; returns their names."""
        names = sorted(r["source"] for r in self.pending().collect())
        self.clean_sources(names)
        return names

    def reclean(self, rounds: int = 3) -> list[list[str]]:
        """Clean again what fails validation, until nothing does; the names of each round."""
        done: list[list[str]] = []
        while failing := sorted(r["source"] for r in C.failing_sources(self.validate()).collect()):
            if len(done) == rounds:
                raise ValueError(f"{len(failing)} sources still fail after {rounds} rounds, first {failing[0]}")
            self.clean_sources(failing)
            done.append(failing)
        return done

    def report(self) -> DataFrame:
        """Per source: rows before and after, removed rows in number and percent. Both counts come from footers; a source
        that has no valid row left has no twin and counts zero clean rows."""
        raw = self.sources().where("ready").select("source", F.col("files").alias("raw_files"), F.col("rows").alias("raw_rows"))
        both = raw.join(self.twins().where("ready").select("source", F.col("rows").alias("clean_rows")), "source", "left").fillna(0, ["clean_rows"])
        removed = F.col("raw_rows") - F.col("clean_rows")
        return both.withColumns({"removed": removed, "removed_pct": F.try_divide(removed * 100.0, F.col("raw_rows").cast("double"))})
