"""Euclidean clustering: points linked when closer than a tolerance.

``clusters`` takes a frame to a task (after voxel grid and crop a frame is small) and knows the size limit;
``components`` is the relational form for frames of any size, without the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .clouds import distinct_points
from .neighbors import edges

COORDS = ["x", "y", "z"]


def _links(xyz: np.ndarray, tol: float, chunk: int = 4096):
    """(i, j) of points closer than ``tol`` (itself included), for ``chunk`` points i at a time in order; by a grid of that side.

    Points are sorted by cell, so the points of a cell are a span; the cells around are looked up among the occupied ones.
    """
    solid = np.isfinite(xyz).all(1)  # what is not finite is near nothing
    who = np.flatnonzero(solid)
    if not len(who):
        return
    cell = np.floor(xyz[who] / tol).astype(np.int64)
    cell -= cell.min(0) - 1
    ny, nz = (int(v) + 2 for v in cell[:, 1:].max(0))
    if (int(cell[:, 0].max()) + 2) * ny * nz >= 1 << 62:
        raise ValueError("the cloud is too wide for this tolerance")
    flat = (cell[:, 0] * ny + cell[:, 1]) * nz + cell[:, 2]
    by = np.argsort(flat, kind="stable")
    held = flat[by]
    around = [(a * ny + b) * nz + c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for s in range(0, len(who), chunk):
        i, j = [], []
        for shift in around:
            want = flat[s : s + chunk] + shift
            lo, hi = np.searchsorted(held, want, "left"), np.searchsorted(held, want, "right")
            n = hi - lo
            if not n.any():
                continue
            own = np.repeat(np.arange(s, s + len(want)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            x, y = who[own], who[by[at]]
            d = xyz[y] - xyz[x]
            near = np.sqrt((d * d).sum(1)) < tol
            i.append(x[near])
            j.append(y[near])
        i, j = np.concatenate(i), np.concatenate(j)
        order = np.lexsort((j, i))
        yield i[order], j[order]


def _roots(n: int, xyz: np.ndarray, tol: float) -> np.ndarray:
    """Smallest index of each point's connected component."""
    root = np.arange(n)
    for i, j in _links(xyz, tol):
        i, j = i[i < j], j[i < j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def grow(xyz: np.ndarray, tol: float, least: int, most: int | None) -> np.ndarray:
    """Cluster number of each point (-1: none). Seeds go by index, growth is breadth-first.

    ``most`` is a soft limit: a point joins first, and is not grown from if the cluster has ``most`` points then. Those that wait
    already still join, so a cluster may be larger; what is not reached makes later clusters. Clusters under ``least``
    are given up, their points used.
    """
    n = len(xyz)
    label = np.full(n, -1)
    if most is None:
        root = _roots(n, xyz, tol)
        kinds, back, size = np.unique(root, return_inverse=True, return_counts=True)
        number = np.where(size >= least, np.cumsum(size >= least) - 1, -1)
        return number[back] if n else label
    parts = list(_links(xyz, tol))
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    first = np.searchsorted(i, np.arange(n + 1))
    used = np.zeros(n, bool)
    number = 0
    for seed in range(n):
        if used[seed]:
            continue
        members, line, at = [], [seed], 0
        while at < len(line):
            p = line[at]
            at += 1
            if used[p]:
                continue
            used[p] = True
            members.append(p)
            if len(members) < most:
                line += j[first[p] : first[p + 1]].tolist()
        if len(members) >= least:
            label[members] = number
            number += 1
    return label


def clusters(points: DataFrame, tol: float, least: int = 1, most: int | None = None) -> DataFrame:
    """(frame_id, cluster_id, point_idx, x, y, z, intensity) of the points in clusters; equal points count once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_idx", kind="stable")
        pdf["cluster_id"] = grow(pdf[COORDS].to_numpy(float), tol, least, most).astype(np.int64)
        return pdf[pdf["cluster_id"] >= 0]

    rows = distinct_points(points)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cluster_id bigint"
    return rows.groupBy("frame_id").applyInPandas(run, schema)


clusters_parallel = clusters  # frames run side by side; seeds are all points, none is drawn at random


def components(points: DataFrame, tol: float, least: int = 1, rounds: int = 50) -> DataFrame:
    """As ``clusters`` without a size limit, by smallest labels passed along the links, doubling their reach a round."""
    rows = distinct_points(points)
    pairs = edges(rows, tol)
    links = cut(pairs.unionByName(pairs.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(rows.select("frame_id", "point_idx", F.col("point_idx").alias("root")))
    for _ in range(rounds):
        seen = links.join(label.select("frame_id", F.col("point_idx").alias("b"), F.col("root").alias("via")), ["frame_id", "b"]).groupBy("frame_id", F.col("a").alias("point_idx")).agg(F.min("via").alias("via"))
        step = label.join(seen, ["frame_id", "point_idx"], "left").select("frame_id", "point_idx", "root", F.least("root", "via").alias("low"))
        jump = step.select("frame_id", F.col("point_idx").alias("low"), F.col("low").alias("far"))
        new = cut(step.join(jump, ["frame_id", "low"], "left").select("frame_id", "point_idx", "root", F.least("low", "far").alias("next")))
        if new.where("next < root").limit(1).count() == 0:
            break
        label = new.select("frame_id", "point_idx", F.col("next").alias("root"))
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    size = label.groupBy("frame_id", "root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = size.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("frame_id").orderBy("root")) - 1).cast("bigint"))
    return label.join(numbered, ["frame_id", "root"]).select("frame_id", "cluster_id", "point_idx").join(rows, ["frame_id", "point_idx"])
