"""Draw lists to pixels: one image a frame, for sinks that want pictures. The lists stay the main form; this is optional."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_pixels(ax: int, ay: int, bx: int, by: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the pixels of a line inside the image: one for each step along its longer side."""
    n = max(abs(bx - ax), abs(by - ay))
    # of a line that leaves the image only the part near it is walked
    low, high = 0.0, float(n)
    for a, b, size in ((ax, bx, width), (ay, by, height)):
        if a == b:
            if not 0 <= a < size:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        p, q = sorted(((-1 - a) * n / (b - a), (size - a) * n / (b - a)))
        low, high = max(low, p), min(high, q)
    t = np.arange(np.floor(low), np.ceil(high) + 1) if low <= high else np.zeros(0)
    t = t[(t >= 0) & (t <= n)]
    x, y = (np.floor(a + t * (b - a) / max(n, 1) + 0.5).astype(np.int64) for a, b in ((ax, bx), (ay, by)))
    keep = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return x[keep], y[keep]


def _colours(column) -> np.ndarray:
    c = np.nan_to_num(np.array(column.tolist(), float).reshape(-1, 3), nan=0.0, posinf=255.0, neginf=0.0)
    return np.clip(np.floor(c + 0.5), 0, 255).astype(np.uint8)


def edges_of(rects: DataFrame) -> DataFrame:
    """The four sides of rectangles (ax, ay, bx, by) as segments."""
    side = lambda k, *c: F.struct(F.lit(k).alias("side"), *(F.col(x).alias(n) for x, n in zip(c, ("ax", "ay", "bx", "by"), strict=True)))
    sides = F.array(side(0, "ax", "ay", "bx", "ay"), side(1, "bx", "ay", "bx", "by"), side(2, "bx", "by", "ax", "by"), side(3, "ax", "by", "ax", "ay"))
    return rects.withColumn("_s", F.explode(sides)).select("frame_id", "box_id", F.col("_s.side").alias("side"), *(F.col(f"_s.{c}").alias(c) for c in ("ax", "ay", "bx", "by")), "colour")


def render(dots: DataFrame, segments: DataFrame, width: int, height: int) -> DataFrame:
    """(frame_id, content, n_drawn): black images of height x width x 3 bytes with the dots (frame_id, point_idx, px, py, colour), the
    last point of a pixel on top, and over them the segments (frame_id, box_id, side, ax, ay, bx, by, colour) in order.

    What lies outside, or has no place, isn't drawn; ``n_drawn`` counts pixels that were. Channels are rounded and held within 0 to 255.
    Of the points only the last of each pixel reaches the task that draws a frame, so that task is bounded by the image.
    """
    inside = dots.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    top = inside.groupBy("frame_id", "px", "py").agg(F.max_by("colour", "point_idx").alias("colour"))
    lines = segments.dropna(subset=["ax", "ay", "bx", "by"])

    def paint(points: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        image, drawn = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
        y, x = points["py"].to_numpy(np.int64), points["px"].to_numpy(np.int64)
        image[y, x], drawn[y, x] = _colours(points["colour"]), True
        sides = sides.sort_values(["box_id", "side"], kind="stable")
        for s, colour in zip(sides.itertuples(index=False), _colours(sides["colour"]), strict=True):
            x, y = segment_pixels(int(s.ax), int(s.ay), int(s.bx), int(s.by), width, height)
            image[y, x], drawn[y, x] = colour, True
        frame = (points if len(points) else sides)["frame_id"].iloc[0]
        return pd.DataFrame({"frame_id": [frame], "content": [image.tobytes()], "n_drawn": [int(drawn.sum())]})

    kind = dots.schema["frame_id"].dataType.simpleString()
    return top.groupBy("frame_id").cogroup(lines.groupBy("frame_id")).applyInPandas(paint, f"frame_id {kind}, content binary, n_drawn long")
