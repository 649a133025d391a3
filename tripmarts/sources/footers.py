"""Footers of Parquet files, read in tasks: one job tells readable, empty, truncated and foreign files and groups schema versions."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the mark at both ends of a Parquet file.
MARK = b"PAR1"
STATUS = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("status", T.StringType()),
                       T.StructField("rows", T.LongType()), T.StructField("columns", T.StringType())])
TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def open_file(uri: str) -> pa.NativeFile:
    """A file of the cluster's store, for reading at any place."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", uri))
    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return store.open_input_file(path)


def probe(uri: str) -> tuple[int, str, int, str | None]:
    """(length, status, rows, columns): `readable`, `empty` (no bytes), `foreign` (not Parquet), `truncated` (starts as Parquet, has no footer) or `damaged`."""
    from pyarrow import parquet

    with open_file(uri) as f:
        length = f.size()
        if length == 0:
            return length, "empty", 0, None
        if f.read_at(4, 0) != MARK:
            return length, "foreign", 0, None
        end = f.read_at(8, length - 8) if length >= 12 else b""
        if end[4:] != MARK or not 0 < struct.unpack("<I", end[:4])[0] <= length - 12:
            return length, "truncated", 0, None
        try:
            meta = parquet.ParquetFile(f).metadata
        except (pa.ArrowInvalid, OSError):
            return length, "damaged", 0, None
        leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
        return length, "readable", meta.num_rows, "\n".join(f"{c.path} {c.physical_type} {c.logical_type} {c.max_definition_level} {c.max_repetition_level}" for c in leaves)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(p, *probe(p)) for p in b.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), TYPES, strict=True)], names=STATUS.names)


def footers(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """path, length, status, rows and columns of the files below folders, globs or files. Only ends of files are read, in tasks.

    The driver lists the files, as Spark does for every scan; hidden files (names starting with _ or .) are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    files = sorted({unquote(f) for f in reader.load(list(paths)).inputFiles()})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(n).mapInArrow(_probe, STATUS)
