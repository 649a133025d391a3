"""Small helpers that the operators for training data share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, so other columns never clash with its own; a null text is empty."""
    return docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text_"))


def fresh_name(taken: Iterable[str], wish: str) -> str:
    """A column name that is not taken (names are compared as Spark does, without case)."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside hand at most so many rows at once to Python workers; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker holds few texts besides the batch it was given."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


#: Caches of the functions that are `kept`, by module.
_kept: dict[str, list] = {}


def kept(make: Callable) -> Callable:
    """A worker keeps what make returns from task to task, until it turns to another operator."""
    cached = lru_cache(maxsize=2)(make)
    _kept.setdefault(make.__module__, []).append(cached)
    return cached


def give_back() -> None:
    """Return freed memory to the system; a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def turn_to(module: str) -> None:
    """Drop what other operators' tasks have kept in this worker, as all operators of a session use the same workers in turn."""
    others = [c for name, caches in _kept.items() if name != module for c in caches if c.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        gc.collect()
        give_back()


def map_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: list[StructField],
                drop_text: bool = False) -> DataFrame:
    """Append columns computed from a text column, batch by batch inside the tasks.

    make() runs once per task and returns the function from a list of texts (null: empty) to one array per field. All other
    columns pass through untouched; the text column goes too if drop_text.
    """
    at = df.columns.index(text_col)
    passed = [i for i in range(len(df.columns)) if not (drop_text and i == at)]
    schema = StructType([df.schema.fields[i] for i in passed] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(make.__module__)
        work = make()
        for batch in slices(batches):
            new = work([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in passed] + new, names=schema.names)
        del work
        give_back()

    return df.mapInArrow(run, schema)
