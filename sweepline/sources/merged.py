"""Scans composed of several files: decoded clouds, and clouds with images in the order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import CLOUD, IMAGE, ordered_merge, tagged_union, until_other
from .clouds import decode_clouds
from .messages import decode, image_files, scan


def scan_clouds(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, point_idx, x, y, z, intensity) of a file of cloud messages; frame_id is the time in nanoseconds."""
    return decode_clouds(decode(scan(spark, path, "point_cloud2"), "point_cloud2"), "ts_ns")


def scan_merged(spark: SparkSession, clouds: str, images: str, image_folder: str | None = None, others: DataFrame | None = None, run_id: int = 0) -> DataFrame:
    """Messages of a cloud file and an image file, interleaved by time: run_id, kind, ts_ns, seq, pos, the cloud's payload columns, the
    image's file. A message of another kind (``others``: kind, ts_ns, seq) ends the run.

    ``seq`` is the place in the file; payloads stay undecoded until ``points_of``.
    """
    place = F.monotonically_increasing_id()  # rows of one file come in its order
    pc = decode(scan(spark, clouds, "point_cloud2"), "point_cloud2").select("ts_ns", place.alias("seq"), "height", "width", "point_step", "data")
    im = image_files(decode(scan(spark, images, "image"), "image")) if image_folder is None else image_files(decode(scan(spark, images, "image"), "image"), image_folder)
    im = im.select("ts_ns", place.alias("seq"), "oid", "file_name")
    rows = tagged_union(**{CLOUD: pc, IMAGE: im})
    if others is not None:
        rows = rows.unionByName(others.select("kind", "ts_ns", "seq"), allowMissingColumns=True)
    return until_other(ordered_merge(rows.withColumn("run_id", F.lit(run_id).cast("bigint"))))


def points_of(merged: DataFrame) -> DataFrame:
    """(frame_id, point_idx, x, y, z, intensity) of the clouds among merged messages; frame_id is the message's pos."""
    return decode_clouds(merged.where(F.col("kind") == CLOUD), "pos")
