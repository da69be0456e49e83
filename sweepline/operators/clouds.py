"""Whole-cloud operators: extents, voxel grids, crops, value difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import inside

COORDS = ("x", "y", "z")


def _number(c: str) -> Column:
    """NaN takes no part in extents."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


def extents(points: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """xmin .. zmax of each group; null where a group has no number. Partial sums make it one small shuffle."""
    aggs = [f(_number(c)).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in COORDS]
    return points.groupBy(*by).agg(*aggs)


def bounding_boxes(points: DataFrame, by: tuple[str, ...] = ("frame_id", "cluster_id")) -> DataFrame:
    """Boxes of clusters, with their number of points."""
    aggs = [f(_number(c)).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in COORDS]
    return points.groupBy(*by).agg(F.count("*").alias("n_points"), *aggs)


def with_cells(points: DataFrame, leaves: tuple[int, int, int]) -> DataFrame:
    """Add ``box_idx``, the cell of a grid that has ``leaves`` cells along each axis of the frame's extent.

    A flat axis has one cell. Cells are counted from floor(min / size), so the largest coordinate can have a cell of its own.
    """
    e = extents(points)
    step, cells = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    dims = []
    for c, n in zip(COORDS, leaves, strict=True):
        size = (F.col(f"{c}max").cast("double") - F.col(f"{c}min")) / F.lit(n)
        e = e.withColumn(f"_i{c}", F.when(size > 0, F.lit(1.0) / size))
        e = e.withColumn(f"_b{c}", F.floor(F.col(f"{c}min") * F.col(f"_i{c}")))
        e = e.withColumn(f"_d{c}", F.coalesce(F.ceil(F.col(f"{c}max") * F.col(f"_i{c}")) - F.col(f"_b{c}") + 1, F.lit(1)))
        dims += [f"_i{c}", f"_b{c}", f"_d{c}"]
    both = points.join(e.select("frame_id", *dims), "frame_id")
    for c in COORDS:
        cells = cells + F.coalesce(F.floor(F.col(c) * F.col(f"_i{c}") - F.col(f"_b{c}")), F.lit(0)) * step
        step = step * F.col(f"_d{c}")
    return both.withColumn("box_idx", cells).drop(*dims)


def voxel_grid(points: DataFrame, leaves: tuple[int, int, int], intensity: str = "last", number: bool = True) -> DataFrame:
    """One point a cell: mean position, and the intensity of the last point in cloud order or (``mean``) the mean one.

    With ``number`` points are numbered by falling cell, cell by cell within a frame.
    """
    value = F.max_by("intensity", "point_idx") if intensity == "last" else F.avg("intensity")
    cells = with_cells(points, leaves).groupBy("frame_id", "box_idx").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in COORDS), value.alias("intensity"), F.count("*").alias("n_points"))
    if not number:
        return cells
    order = Window.partitionBy("frame_id").orderBy(F.desc("box_idx"))
    return cells.withColumn("point_idx", (F.row_number().over(order) - 1).cast("bigint"))


def crop(points: DataFrame, low: tuple, high: tuple, drop: bool = False) -> DataFrame:
    """Points inside the box, or outside with ``drop``: a filter, no shuffle."""
    test = inside(low, high)
    return points.where(~test if drop else test)


def difference(points: DataFrame, without: DataFrame, by: str = "value") -> DataFrame:
    """Points of a cloud that are not in another; every copy of a point goes. NaN differs from itself.

    ``by`` is ``value`` (position and intensity) or ``index`` (point_idx).
    """
    keys = ["frame_id", "point_idx"] if by == "index" else ["frame_id", *COORDS, "intensity"]
    other = without.select(*keys)
    if by == "value":
        number = F.lit(True)
        for c in COORDS:
            number = number & ~F.isnan(F.col(c).cast("double"))
        other = other.where(number)
    return points.join(other.distinct(), keys, "left_anti")


def distinct_points(points: DataFrame) -> DataFrame:
    """The first of equal points in each frame."""
    return points.groupBy("frame_id", *COORDS, "intensity").agg(F.min("point_idx").alias("point_idx"))


def kind_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("kind").agg(F.count("*").alias("n"))
