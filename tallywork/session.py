"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tallywork", partitions: int | None = None, master: str | None = None) -> SparkSession:
    """UTC, adaptive plans with skew joins; partitions and master only where they are given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session may do without."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there; unlike a checkpoint it has the sizes of its files.

    With ``rows`` a file has that many at most and is packed closer, for tables of texts: a task reads about thirty small files, so what it makes of them is bounded.
    """
    checkpoint_dir = df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{checkpoint_dir or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    out = df.write if rows is None else df.write.option("maxRecordsPerFile", rows).option("compression", "zstd")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
