"""Intermediate tables that several later steps read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local one is made only where all tasks run in the driver's own process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"echotrace-{os.getpid()}"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, so that nothing stays cached and lost executors cost no more than their tasks."""
    _folder(df.sparkSession)
    return df.checkpoint()


def new_table(spark: SparkSession) -> str:
    """A path for stored() in the checkpoint folder."""
    return f"{_folder(spark)}/table-{uuid.uuid4()}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like kept, as a Parquet table: for large tables, which take less room in columns."""
    path = path or new_table(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, size: int = 1 << 22) -> None:
    """Bound Arrow batches by bytes, as texts can be long; a session's own smaller setting stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))
