"""Box expressions: 3-D boxes xmin..zmax, image boxes left, top, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .points import distance


def _c(name):
    return F.col(name) if isinstance(name, str) else name


def diagonal() -> Column:
    return distance(*(F.col(c) for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")))


def extents() -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{a}max") - F.col(f"{a}min") for a in "xyz")


def wireframe() -> Column:
    """The 12 edges of a box as structs (edge, ax, ay, az, bx, by, bz), in screen axes: y, z, x of the LiDAR."""
    low, high = [F.col(f"{a}min") for a in "yzx"], [F.col(f"{a}max") for a in "yzx"]
    corners = {k: [high[i] if k >> i & 1 else low[i] for i in range(3)] for k in range(8)}
    pairs = [(a, a | 1 << i) for a in range(8) for i in range(3) if not a >> i & 1]
    names = ("ax", "ay", "az", "bx", "by", "bz")
    return F.array(*(F.struct(F.lit(e).alias("edge"), *(c.alias(n) for n, c in zip(names, corners[a] + corners[b], strict=True))) for e, (a, b) in enumerate(pairs)))


def roi_points(left="left", top="top", width="width", height="height") -> Column:
    """Corners clockwise from the top left."""
    x, y, w, h = map(_c, (left, top, width, height))
    corners = ((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    return F.array(*(F.struct(F.lit(i).alias("corner"), a.alias("px"), b.alias("py")) for i, (a, b) in enumerate(corners)))


def contains(px: Column, py: Column, left="left", top="top", width="width", height="height") -> Column:
    """Half-open: the right and lower edges are outside."""
    x, y, w, h = map(_c, (left, top, width, height))
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def shrunk(share: float, left="left", top="top", width="width", height="height") -> list[Column]:
    """left, top, width, height of a box made smaller by a share, cut toward zero."""
    x, y, w, h = map(_c, (left, top, width, height))

    def inset(start, size):
        return start + (size.cast("double") * F.lit(share) / 2).cast("int"), (size.cast("double") * F.lit(1 - share)).cast("int")

    (x, w), (y, h) = inset(x, w), inset(y, h)
    return [x, y, w, h]


def from_centre(cx: Column, cy: Column, w: Column, h: Column, cols: Column, rows: Column) -> list[Column]:
    """Integer box of a detector's relative centre and size."""
    x, y, bw, bh = ((v * s).cast("int") for v, s in ((cx, cols), (cy, rows), (w, cols), (h, rows)))
    return [x - (bw / 2).cast("int"), y - (bh / 2).cast("int"), bw, bh]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct columns with left, top, width, height."""
    def part(s, f):
        return F.col(f"{s}.{f}")

    w = F.least(part(a, "left") + part(a, "width"), part(b, "left") + part(b, "width")) - F.greatest(part(a, "left"), part(b, "left"))
    h = F.least(part(a, "top") + part(a, "height"), part(b, "top") + part(b, "height")) - F.greatest(part(a, "top"), part(b, "top"))
    both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return F.try_divide(both, part(a, "width") * part(a, "height") + part(b, "width") * part(b, "height") - both)
