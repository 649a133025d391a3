"""Cutting lineage of iterative plans through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="tripmarts-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so a lost executor does not replay earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, visible to every executor."""
    import uuid
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def compiled_apart(df: DataFrame) -> DataFrame:
    """The same rows; expressions before and after go into separate generated code.

    The JVM never compiles a method of more than 8,000 bytes of bytecode, and Spark fuses neighbouring projections into one. An observed
    row count ends the fused part.
    """
    import uuid
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written to a new folder and read again: Spark knows its size, so small tables are broadcast and large ones stay in place."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
