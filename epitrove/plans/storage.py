"""Scratch tables on the storage the cluster names."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="epitrove-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder it was given otherwise.

    A session whose executors are threads of this process, and only such a one, may do without
    either; it gets a folder that is removed when the process ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/epitrove/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a table written between two jobs."""
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this session; DataFrames built on them can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Later jobs see the very same rows, an executor that is lost takes nothing with it, and the
    planner knows the size of what it reads.
    """
    path = scratch_path(df.sparkSession, "pinned")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
