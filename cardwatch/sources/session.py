"""Session settings the library reads, and how it cuts lineage."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scratch: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, else one of our own on a single machine, else None."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="cardwatch-")
    return _scratch[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table or a stream."""
    root = checkpoint_root(spark)
    if root is None:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def enable_checkpoints(spark: SparkSession) -> None:
    """Let long iterations of Spark ML cut their lineage in the shared folder; a folder already set is kept."""
    root = checkpoint_root(spark)
    if root is not None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)


def materialize(df: DataFrame) -> DataFrame:
    """Store a frame that several jobs read as a table in the shared folder.

    The stored table has no lineage, so losing executors costs no recompute, and its footers answer row counts.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
