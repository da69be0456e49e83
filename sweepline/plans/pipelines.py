"""Composed pipelines: LiDAR frames to boxes, fusion with images, batch rectification, draw lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import wireframe
from ..functions.camera import project, rectify_map, remap
from ..functions.draw import marker_colour, overlay_colour, top_view, top_view_colour
from ..operators.boxes import Plausible, ego_front, is_ahead, plausible
from ..operators.cluster import clusters
from ..operators.clouds import bounding_boxes, crop, voxel_grid
from ..operators.merge import latest_state, ordered_merge
from ..operators.plane import segment
from ..operators.vision import fuse, image_front, lidar_range, point_lists
from ..functions.points import ahead
from ..storage import cut
from .presets import DRIVE, LidarPipeline


@dataclass
class LidarResult:
    inliers: DataFrame
    outliers: DataFrame
    clusters: DataFrame
    boxes: DataFrame


def lidar(points: DataFrame, p: LidarPipeline = DRIVE, rule: Plausible = Plausible()) -> LidarResult:
    """Voxel grid, crop, ego crop, plane, clusters, plausible boxes: one plan keyed by frame_id."""
    cloud = crop(voxel_grid(points, p.leaves), *p.keep)
    if p.drop:
        cloud = crop(cloud, *p.drop, drop=True)
    cloud = cut(cloud)  # the plane reads it four times
    split = segment(cloud, p.iterations, p.plane_limit)
    outliers = split.where("not is_inlier").drop("is_inlier")
    found = clusters(outliers.select("frame_id", "point_idx", "x", "y", "z", "intensity"), p.tol, p.least, p.most)
    return LidarResult(split.where("is_inlier").drop("is_inlier"), outliers, found, plausible(bounding_boxes(found), rule))


def project_points(points: DataFrame, m: np.ndarray) -> DataFrame:
    """Add pixel px, py and depth."""
    u, v, depth = project(m, F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    return points.withColumns({"px": u, "py": v, "depth": depth})


def fused_events(messages: DataFrame) -> DataFrame:
    """Events at which a cloud and an image are known, by time order of a run."""
    return latest_state(ordered_merge(messages))


def lidar_points(events: DataFrame, clouds: DataFrame, images: DataFrame, shrink: float = 0.1, accumulate: bool = False) -> DataFrame:
    """(run_id, pos, box_id, lidar_points): points in the boxes of the event's image.

    ``clouds`` has run_id, seq, point_idx, x, y, z, px, py; ``images`` has run_id, seq and the boxes. With ``accumulate`` the
    points of all events that share the image so far are kept, the newest last; else an event has its own only.
    """
    at = events.withColumn("_event", F.concat_ws(":", "run_id", "pos"))
    points = at.join(clouds.withColumnRenamed("seq", "pc_seq"), ["run_id", "pc_seq"])
    boxes = at.join(images.withColumnRenamed("seq", "image_seq"), ["run_id", "image_seq"])
    hits = fuse(points, boxes.select("_event", "box_id", "left", "top", "width", "height"), shrink, "_event")
    if accumulate:
        later = at.select("run_id", F.col("pos").alias("_at"), "image_seq", F.col("_event").alias("_to"))
        hits = hits.drop("_event").join(later, ["run_id", "image_seq"]).where("pos <= _at").withColumn("_event", F.col("_to"))
        lists = hits.groupBy("_event", "box_id").agg(F.array_sort(F.collect_list(F.struct("pos", "point_idx", "x", "y", "z"))).alias("lidar_points"))
    else:
        lists = point_lists(hits, "_event")
    return lists.join(at.select("_event", "run_id", "pos"), "_event").drop("_event")


def fused_frames(frames: DataFrame, boxes: DataFrame, members: DataFrame, image_boxes: DataFrame) -> DataFrame:
    """One record a frame: its boxes, the LiDAR target with its points, and the image target.

    ``boxes`` are LiDAR boxes, ``members`` clustered points; everything is keyed by frame_id.
    """
    every = boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "cluster_id", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))).alias("lidar_bbs"))
    target = ego_front(boxes).select("frame_id", F.struct("box_id", "cluster_id", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax").alias("target_lidar_bb"))
    own = target.select("frame_id", F.coalesce("target_lidar_bb.cluster_id", F.lit(0)).alias("cluster_id")).join(members, ["frame_id", "cluster_id"])
    points = own.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("point_idx", "x", "y", "z"))).alias("target_lidar_points"))
    seen = image_boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "left", "top", "width", "height"))).alias("image_bbs"))
    front = image_front(image_boxes.select("frame_id", "box_id", "left", "top", "width", "height"))
    front = front.select("frame_id", F.struct("box_id", "left", "top", "width", "height").alias("target_image_bb"))
    out = frames
    for part in (every, target, points, seen, front):
        out = out.join(part, "frame_id", "left")
    return out


def rectify(images: DataFrame, k: np.ndarray, d: np.ndarray, r: np.ndarray, new_k: np.ndarray, size: tuple[int, int], decode: Callable[[bytes], np.ndarray], encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(oid, content): every image remapped; the map is made once a task. ``decode`` and ``encode`` handle the file format."""

    def run(batches):
        mx, my = rectify_map(k, d, r, new_k, *size)
        for pdf in batches:
            pdf = pdf[pdf["content"].notna()]
            yield pdf.assign(content=[encode(remap(decode(bytes(c)), mx, my)) for c in pdf["content"]])

    return images.select("oid", "content").mapInPandas(run, "oid string, content binary")


def top_view_list(points: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draw lists of the view from above: coloured points, and coloured boxes."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    (px, py), colour = top_view(x, y), top_view_colour(x, y, z)
    dots = points.select("frame_id", "point_idx", px.cast("int").alias("px"), py.cast("int").alias("py"), F.array(*colour).alias("colour"))
    (ax, ay), (bx, by) = top_view(F.col("xmin"), F.col("ymin")), top_view(F.col("xmax"), F.col("ymax"))
    mark = F.when(is_ahead(), F.lit(1)).otherwise(F.lit(0))
    rects = boxes.select("frame_id", "box_id", ax.cast("int").alias("ax"), ay.cast("int").alias("ay"), bx.cast("int").alias("bx"), by.cast("int").alias("by"), marker_colour(mark, F.lit(1)).alias("colour"), F.coalesce("box_id", F.lit(0)).cast("string").alias("label"))
    return dots, rects


def overlay_list(points: DataFrame, boxes: DataFrame, m: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Draw lists over the image: points ahead with colours by the frame's extents, and box edges."""
    seen = project_points(points.where(ahead()), m)
    e = lidar_range(seen, ["frame_id"])
    both = seen.join(e, "frame_id")
    spans = tuple(F.col(f"{c}max") - F.col(f"{c}min") for c in "xyz")
    colour = overlay_colour(F.col("x"), F.col("y"), F.col("z"), F.col("xmin"), spans)
    dots = both.select("frame_id", "point_idx", F.col("px").try_cast("int").alias("px"), F.col("py").try_cast("int").alias("py"), F.array(*colour).alias("colour"))
    lines = boxes.select("frame_id", "box_id", F.inline(wireframe()))
    return dots, lines
