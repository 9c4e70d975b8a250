"""Tables that a job keeps between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without it gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/studyloom-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, str] = {}


def _status(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(name: str, source: DataFrame, build: Callable[[DataFrame, str], None]) -> str:
    """The folder of what build(source, folder) has written: once an application, and again if the source's files have changed."""
    spark = source.sparkSession
    files = []
    for f in source.inputFiles():
        fs, where = _status(spark, f)
        found = fs.getFileStatus(where)
        files.append((f, found.getLen(), found.getModificationTime()))
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, *sorted(files))
    if key in _STORED:
        fs, where = _status(spark, _STORED[key])
        if fs.exists(where):
            return _STORED[key]
    path = new_folder(spark)
    build(source, path)
    _STORED[key] = path
    return path
