"""Fixed-radius search as an equi-join on grid cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.points import distance

COORDS = ("x", "y", "z")


def _cells(points: DataFrame, tol: float) -> DataFrame:
    return points.withColumns({f"_c{c}": F.floor(F.col(c).cast("double") / F.lit(tol)) for c in COORDS})


def radius_search(targets: DataFrame, cloud: DataFrame, tol: float) -> DataFrame:
    """(frame_id, target_idx, neighbour_idx, dist) with dist < tol, a point being its own neighbour.

    Cells have side ``tol``, so neighbours are in the 27 cells around: only the targets are repeated, and the
    join is on frame and cell. Targets bear frame_id, point_idx, x, y, z.
    """
    around = F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for v, c in zip(d, COORDS, strict=True))) for d in product((-1, 0, 1), repeat=3)))
    t = _cells(targets.select("frame_id", F.col("point_idx").alias("target_idx"), *COORDS), tol)
    t = t.withColumn("_d", F.explode(around)).select("frame_id", "target_idx", *(F.col(c).alias(f"t{c}") for c in COORDS), *((F.col(f"_c{c}") + F.col(f"_d.d{c}")).alias(f"_c{c}") for c in COORDS))
    p = _cells(cloud.select("frame_id", F.col("point_idx").alias("neighbour_idx"), *COORDS), tol)
    d = distance(*(F.col(f"t{c}") for c in COORDS), *(F.col(c).cast("double") for c in COORDS))
    return t.join(p, ["frame_id", *(f"_c{c}" for c in COORDS)]).withColumn("dist", d).where(F.col("dist") < tol).select("frame_id", "target_idx", "neighbour_idx", "dist")


def edges(cloud: DataFrame, tol: float) -> DataFrame:
    """(frame_id, a, b) with a < b: pairs closer than ``tol``; half of the cells around do."""
    half = [d for d in product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
    around = F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for v, c in zip(d, COORDS, strict=True))) for d in half))
    p = _cells(cloud.select("frame_id", "point_idx", *COORDS), tol)
    a = p.withColumn("_d", F.explode(around)).select("frame_id", F.col("point_idx").alias("a"), *(F.col(c).alias(f"t{c}") for c in COORDS), F.struct(*(F.col(f"_d.d{c}") for c in COORDS)).alias("_d"), *((F.col(f"_c{c}") + F.col(f"_d.d{c}")).alias(f"_c{c}") for c in COORDS))
    b = p.withColumnRenamed("point_idx", "b")
    own = F.expr("_d.dx = 0 and _d.dy = 0 and _d.dz = 0")
    near = a.join(b, ["frame_id", *(f"_c{c}" for c in COORDS)]).where(distance(*(F.col(f"t{c}") for c in COORDS), *(F.col(c) for c in COORDS)) < tol).where(~own | (F.col("a") < F.col("b")))
    return near.select("frame_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
