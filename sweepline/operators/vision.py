"""Image detections: classes, suppression, numbering, and fusion with projected points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import contains, from_centre, shrunk

EGO_BONNET = (630, 660)
FRONT_PIXEL = (1150, 800)


def best_class(raw: DataFrame, scores: str = "scores") -> DataFrame:
    """Add class_id and confidence: the largest score and its first place. Empty scores give nulls."""
    top = F.array_max(scores)
    return raw.withColumns({"confidence": top, "class_id": (F.array_position(scores, top) - 1).cast("int")})


def confident(detections: DataFrame, threshold: float = 0.4) -> DataFrame:
    return detections.where(F.col("confidence") > F.lit(threshold))


def to_boxes(raw: DataFrame) -> DataFrame:
    """Integer boxes from relative centres and sizes."""
    left, top, width, height = from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("img_w"), F.col("img_h"))
    return raw.withColumns({"left": left, "top": top, "width": width, "height": height})


def keep_largest(boxes: np.ndarray, scores: np.ndarray, order: np.ndarray, limit: float) -> np.ndarray:
    """Greedy suppression: flags of the boxes kept, best score first, ties by ``order``."""
    keep = np.zeros(len(scores), bool)
    x1, y1 = boxes[:, 0], boxes[:, 1]
    x2, y2 = x1 + boxes[:, 2], y1 + boxes[:, 3]
    area = boxes[:, 2] * boxes[:, 3]
    for i in np.lexsort((order, -scores)):
        k = np.flatnonzero(keep)
        w = np.minimum(x2[i], x2[k]) - np.maximum(x1[i], x1[k])
        h = np.minimum(y2[i], y2[k]) - np.maximum(y1[i], y1[k])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[i] + area[k] - both
        keep[i] = not (both > limit * union).any()
    return keep


def suppress(detections: DataFrame, limit: float = 0.5, threshold: float = 0.4, image: str = "image_oid") -> DataFrame:
    """Non-maximum suppression over all classes of an image: one image's detections go to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = pdf[["left", "top", "width", "height"]].to_numpy(np.int64)
        return pdf[keep_largest(boxes, pdf["confidence"].to_numpy(float), pdf["row_idx"].to_numpy(), limit)]

    return confident(detections, threshold).groupBy(image).applyInPandas(run, detections.schema)


def number_boxes(boxes: DataFrame, image: str = "image_oid", ego: bool = False, order: str = "row_idx") -> DataFrame:
    """Add box_id, counted after boxes over the ego vehicle's bonnet are left out (unless ``ego``)."""
    if not ego:
        boxes = boxes.where(~contains(*map(F.lit, EGO_BONNET)))
    return boxes.withColumn("box_id", (F.row_number().over(Window.partitionBy(image).orderBy(F.desc("confidence"), order)) - 1).cast("int"))


def with_class_names(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``class`` by class_id; unknown ids have none."""
    return boxes.join(names, "class_id", "left")


def to_blob(image: np.ndarray, size: tuple[int, int] = (416, 416)) -> np.ndarray:
    """A detector's input (1, channels, height, width): values from 0 to 1, sides fitted by linear interpolation, channel order as it is."""
    image = np.asarray(image, np.float32)
    if image.ndim == 2:
        image = image[..., None]
    for axis, new in ((1, size[0]), (0, size[1])):
        old = image.shape[axis]
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)]).astype(np.float32)
        image = image.take(low, axis) * (1 - part) + image.take(np.minimum(low + 1, old - 1), axis) * part
    return (image / np.float32(255)).transpose(2, 0, 1)[None]


def detect(
    images: DataFrame, load: Callable[[], Callable[[bytes], np.ndarray]], classes: int, threshold: float = 0.4, limit: float = 0.5, decode: Callable[[bytes], np.ndarray] | None = None, size: tuple[int, int] = (416, 416)
) -> DataFrame:
    """Run a detector over (image_oid, content, img_w, img_h); ``load`` is called once a task.

    The model returns rows of cx, cy, w, h, objectness and one score a class. With ``decode`` (file to pixels) it is given the
    blob of the image, else the content as it is.
    """
    if classes < 1:
        raise ValueError("a detector has classes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for k, row in enumerate(model(r.content if decode is None else to_blob(decode(bytes(r.content)), size))):
                    out.append((r.image_oid, k, *map(float, row[:4]), [float(v) for v in row[5 : 5 + classes]], r.img_w, r.img_h))
            yield pd.DataFrame(out, columns=["image_oid", "row_idx", "cx", "cy", "w", "h", "scores", "img_w", "img_h"])

    raw = images.mapInPandas(run, "image_oid string, row_idx int, cx float, cy float, w float, h float, scores array<float>, img_w int, img_h int")
    return number_boxes(suppress(to_boxes(confident(best_class(raw), threshold)), limit, threshold))


def fuse(points: DataFrame, boxes: DataFrame, shrink: float = 0.1, key: str = "frame_id") -> DataFrame:
    """Points (with pixel px, py) with the first box that contains them, all boxes made smaller by ``shrink``; others go.

    The boxes of a frame travel as one sorted array, so a point stays one row whatever the number of boxes.
    """
    left, top, width, height = shrunk(shrink)
    held = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("box_id", left.alias("l"), top.alias("t"), width.alias("w"), height.alias("h")))).alias("_boxes"))
    px, py = F.col("px").try_cast("int"), F.col("py").try_cast("int")
    hit = F.filter("_boxes", lambda b: contains(px, py, b["l"], b["t"], b["w"], b["h"]))
    return points.join(held, key).withColumn("box_id", F.get(hit, F.lit(0))["box_id"]).drop("_boxes").where("box_id is not null")


def point_lists(fused: DataFrame, key: str = "frame_id") -> DataFrame:
    """(frame, box_id, lidar_points): the points of each box in cloud order; boxes without points have no row."""
    return fused.groupBy(key, "box_id").agg(F.array_sort(F.collect_list(F.struct("point_idx", "x", "y", "z"))).alias("lidar_points"))


def image_front(boxes: DataFrame, pixel: tuple[int, int] = FRONT_PIXEL, key: str = "frame_id") -> DataFrame:
    """The first image box over the pixel straight ahead."""
    rest = [c for c in boxes.columns if c != key]
    first = boxes.where(contains(*map(F.lit, pixel))).groupBy(key).agg(F.min_by(F.struct(*rest), "box_id").alias("_b"))
    return first.select(key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def lidar_range(points: DataFrame, by: list[str]) -> DataFrame:
    """Extents of points in a group, for colours."""
    aggs = [f(c).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return points.groupBy(*by).agg(*aggs)
