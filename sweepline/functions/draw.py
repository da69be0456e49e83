"""Draw-list expressions: where and in which colour things are drawn; rasterising is left to a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The top view shows 100 m by 24 m at 5 pixels a metre.
WORLD_LENGTH, WORLD_WIDTH, PIXELS = 100, 24, 5
ROOF, HEIGHT = 4.75, 7.75
TARGET, OTHER = (128, 128, 256), (255, 128, 128)


def top_view(x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel of a world point seen from above: ahead is up, left is left."""
    return y * F.lit(-PIXELS) + F.lit(WORLD_WIDTH * PIXELS / 2), x * F.lit(-PIXELS) + F.lit(WORLD_LENGTH * PIXELS / 2)


def top_view_colour(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Height, range and nearness as colour channels."""
    half = WORLD_LENGTH / 2
    return (z + F.lit(ROOF)) * F.lit(255 / HEIGHT), F.sqrt(x * x + y * y) * F.lit(255 / half), (F.lit(half) - F.abs(x)) * F.lit(255 / half)


def overlay_colour(x: Column, y: Column, z: Column, low: Column, spans: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """Colour of a point over the image; all channels are counted from the smallest x."""
    return tuple(F.coalesce(F.try_divide(F.lit(255.0) * (c - low), s), F.lit(0.0)) for c, s in zip((x, y, z), spans, strict=True))


def label(box_id: Column, name: Column, confidence: Column) -> Column:
    return F.format_string("%d %s %3.2f", box_id, name, confidence)


def label_box(left: Column, top: Column, text_width: Column, text_height: Column, baseline: Column, widen: float = 1.05, heighten: float = 1.25) -> tuple[Column, Column, Column, Column]:
    """(left, top, width, height) of the filled rectangle behind a label that stands on ``top``, never above the image.

    The size of the text comes from the sink's font. Factors are those of the image; the view from above has 1.5 for both.
    """
    scaled = lambda c, k: F.round(F.lit(k).cast("float") * c.cast("float")).cast("int")
    tall = scaled(text_height, heighten)
    return left, F.greatest(top, text_height) - tall, scaled(text_width, widen), baseline + tall


def marker_colour(box_id: Column, target: Column | None = None) -> Column:
    """Colour of a box: the target's differs."""
    target = F.lit(99_999) if target is None else F.coalesce(target, F.lit(99_999))
    colour = lambda c: F.array(*map(F.lit, c))
    return F.when(box_id == target, colour(TARGET)).otherwise(colour(OTHER))


def range_markers(spark: SparkSession, spacing: float = 10.0) -> DataFrame:
    """(marker, y): a line across the top view every ``spacing`` metres."""
    n = int(WORLD_LENGTH / spacing)
    rows = spark.range(n).withColumnRenamed("id", "marker")
    return rows.select("marker", (F.lit(float(WORLD_LENGTH * PIXELS)) - F.col("marker") * F.lit(spacing * PIXELS)).cast("int").alias("y"))
