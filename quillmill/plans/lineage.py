"""Cutting a long plan at a table that executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set and the master is local, as in tests, a temporary folder of this machine serves.  On a cluster it would not be shared, so that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def release() -> None:
    """Deletes all tables that were cut so far; DataFrames that read them can't be used any more.  Runs by itself when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112 - the session has ended
            continue


atexit.register(release)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once, now, to the shared folder and read back: later stages neither repeat its work nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
