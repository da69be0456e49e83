"""LiDAR boxes: plausibility, numbering, the one ahead of the ego vehicle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import extents


@dataclass(frozen=True)
class Plausible:
    """What a vehicle's box may be, in metres."""

    zmin: float = -4.0
    zmax: float = 1.0
    dx: tuple[float, float] = (0.3, 6.0)
    dy: tuple[float, float] = (0.3, 6.0)
    dz: tuple[float, float] = (0.2, 4.0)


def plausible(boxes: DataFrame, rule: Plausible = Plausible()) -> DataFrame:
    """Boxes a vehicle could have, numbered anew by ``box_id``; cluster_id keeps the number from before."""
    dx, dy, dz = extents()
    fits = (F.col("zmin") >= rule.zmin) & (F.col("zmax") <= rule.zmax) & dx.between(*rule.dx) & dy.between(*rule.dy) & dz.between(*rule.dz)
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("cluster_id")) - 1
    return boxes.where(fits).withColumn("box_id", number.cast("int"))


def rejected_nearby(boxes: DataFrame, rule: Plausible = Plausible()) -> DataFrame:
    """Boxes turned down although ahead and near: for inspection."""
    dx, dy, dz = extents()
    fits = (F.col("zmin") >= rule.zmin) & (F.col("zmax") <= rule.zmax) & dx.between(*rule.dx) & dy.between(*rule.dy) & dz.between(*rule.dz)
    return boxes.where(~fits & (F.col("xmax") > 0) & (F.col("ymax") < 8))


def is_ahead(reach: float = 25.0, side: float = 1.5):
    """A box whose near face is within ``reach`` ahead and whose nearer side is within ``side`` of the axis."""
    y = F.when(F.col("ymin") < 0, F.col("ymax")).otherwise(F.col("ymin"))
    return (F.col("xmin") > 0) & (F.col("xmin") < reach) & (y > -side) & (y < side)


def ego_front(boxes: DataFrame, reach: float = 25.0, side: float = 1.5) -> DataFrame:
    """The first box ahead of the ego vehicle in each frame."""
    rest = [c for c in boxes.columns if c != "frame_id"]
    first = boxes.where(is_ahead(reach, side)).groupBy("frame_id").agg(F.min_by(F.struct(*rest), "box_id").alias("_b"))
    return first.select("frame_id", *(F.col(f"_b.{c}").alias(c) for c in rest))
