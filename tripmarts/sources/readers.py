"""Trip files, dimensions and marts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmarts.functions.hashing import draw, draw_unit
from tripmarts.sources.footers import footers
from tripmarts.sources.schemas import FAMILIES, PICKUP


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the canonical columns by name (case-insensitive); absent columns become NULL."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*cols)


def read_family(spark: SparkSession, family: str, *paths: str, source: bool = False) -> DataFrame:
    """One trip family from folders, globs or explicit files, conformed to its schema.

    Files with equal schemas share one scan, so the plan has one branch per schema version, also where columns come
    or change type among the files of one path. `source` keeps the file path as `source_file`.
    """
    schema = FAMILIES[family]
    groups: dict[str, list[str]] = {}
    for r in footers(spark, *paths).orderBy("path").collect():  # one small row a file, as Spark itself lists them
        if r["status"] != "readable":
            raise ValueError(f"{r['path']} is {r['status']}")
        groups.setdefault(r["columns"], []).append(r["path"])
    if not groups:
        raise FileNotFoundError(f"no files below {', '.join(paths)}")
    out = None
    for same in groups.values():
        raw = spark.read.parquet(*same)
        part = conform(raw, schema)
        if source:
            part = conform(raw.withColumn("source_file", F.col("_metadata.file_path")), T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]))
        out = part if out is None else out.unionByName(part)
    return out


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan with schemas merged by name; for files whose types agree."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write_partitioned(df: DataFrame, family: str, path: str) -> None:
    """Clean trips by pickup year and month, so that year and month filters prune folders."""
    ts = F.col(PICKUP[family])
    keyed = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    # Rebalance splits a month that is too large for one writer and merges small leftovers.
    keyed.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").option("compression", "zstd").parquet(path)


def read_years(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """Partition-pruned read of whole years."""
    return spark.read.parquet(path).where(F.col("year").isin(years))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows chosen by the hash of a key: the same ones on every run."""
    return df.orderBy(draw("sample", F.col(key)), key).limit(n)


def sample_fraction(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hashes below the fraction; no shuffle."""
    return df.where(draw_unit("sample", F.col(key)) < fraction)


def file_status(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """Each file with its size, its status and the rows of its footer. An empty table is readable and has no rows."""
    return footers(spark, *paths, pattern=pattern).drop("columns").withColumn("readable", F.col("status") == "readable")


def read_good(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan that skips corrupt files."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types from the schema, or inferred for small reference files."""
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """One JSON map {id: [lat, lon, name]} per file."""
    return parse_stations(spark.read.text(path, wholetext=True), "value")


def parse_stations(payload: DataFrame, column: str) -> DataFrame:
    parsed = payload.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("station_id", "v"))
    return parsed.select("station_id", F.col("v")[0].cast("double").alias("lat"), F.col("v")[1].cast("double").alias("lon"), F.col("v")[2].alias("station_name"))
