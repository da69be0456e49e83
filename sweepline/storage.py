"""The folder that the driver and all executors share, and what is written there for a while."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and everything runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="sweepline-")
        shared_folder.own = root
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name for a folder of one's own on the shared storage."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept on the shared storage: what they came from may go."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any Hadoop file system."""
    target, fs = _file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
