"""Point expressions. ``p`` arguments are columns; x points ahead, y left, z up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1, y1, z1, x2, y2, z2) -> Column:
    """Euclidean distance."""
    dx, dy, dz = x1 - x2, y1 - y2, z1 - z2
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def norm(x="x", y="y", z="z") -> Column:
    x, y, z = F.col(x), F.col(y), F.col(z)
    return F.sqrt(x * x + y * y + z * z)


def scaled(value: Column, factor: int) -> Column:
    """value * factor cut toward zero, as a long; null where it does not fit."""
    return (value.cast("double") * F.lit(factor)).try_cast("bigint")


def sort_key() -> list[Column]:
    """Order of points: whole millimetres from the origin, then tenths of intensity, no intensity first."""
    return [scaled(norm(), 1000).asc_nulls_first(), scaled(F.col("intensity"), 10).asc_nulls_first()]


def hash_key() -> Column:
    """Hash of whole millimetres; equality of points stays exact."""
    return F.xxhash64(scaled(F.col("x"), 1000), scaled(F.col("y"), 1000), scaled(F.col("z"), 1000), scaled(F.col("intensity"), 10))


def xyz() -> Column:
    return F.array("x", "y", "z")


def payload(name: str = "intensity") -> Column:
    """Payload value, 0 where the point has none."""
    return F.coalesce(F.col(name), F.lit(0.0))


def inside(low: tuple, high: tuple) -> Column:
    """Point in an axis-aligned box, both ends included; null and NaN coordinates are outside."""
    test = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        test = test & F.col(c).between(F.lit(a), F.lit(b)) & ~F.isnan(F.col(c).cast("double"))
    return F.coalesce(test, F.lit(False))


def ahead(half_angle: float = 45.0) -> Column:
    """In the horizontal field of view ahead."""
    return (F.col("x") > 0) & (F.abs(F.atan2("y", "x")) < F.radians(F.lit(half_angle)))
