"""Cameras: projection of LiDAR points, pinhole model with distortion, rectification maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.calibration import StereoCalibration

# Position of the LiDAR in each camera's frame; axes are right, down, ahead.
LIDAR_AXES = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
LEFT_OFFSET = (0.25, -0.125, -0.115)
RIGHT_OFFSET = (-0.25, -0.125, -0.115)


def projection(p: np.ndarray, r0: np.ndarray, lidar: np.ndarray) -> np.ndarray:
    """3x4 matrix from LiDAR coordinates to homogeneous pixels: camera matrix, rectifying rotation, pose."""
    r, l = np.eye(4), np.eye(4)
    r[:3, :3], l[:3] = r0, lidar
    return p @ r @ l


def rig(calibration: StereoCalibration, side: str, p: str | None = None, r0: str | None = None) -> np.ndarray:
    """Projection of the ``left`` or ``right`` camera. The left one pairs P1 with R2, the right one P2 with R1;
    other matrices can be named."""
    names = {"left": ("P1", "R2", LEFT_OFFSET), "right": ("P2", "R1", RIGHT_OFFSET)}[side]
    lidar = np.c_[np.array(LIDAR_AXES), np.array(names[2])]
    return projection(calibration[p or names[0]], calibration[r0 or names[1]], lidar)


def project(m: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, depth): null pixel where the depth is 0; points behind the camera project as well."""
    rows = [sum((F.lit(float(m[i, j])) * c for j, c in enumerate((x, y, z))), F.lit(0.0)) + F.lit(float(m[i, 3])) for i in range(3)]
    return F.try_divide(rows[0], rows[2]), F.try_divide(rows[1], rows[2]), rows[2]


@dataclass(frozen=True)
class CameraInfo:
    """Pinhole intrinsics with Brown-Conrady distortion k1, k2, p1, p2, k3."""

    name: str
    fx: float
    fy: float
    cx: float
    cy: float
    distortion: tuple[float, float, float, float, float]


# Intrinsics of two cameras.
BRIO = CameraInfo("brio", 755.925188, 756.065280, 632.358702, 346.628380, (0.15477853459080293, -0.2540365747115118, -0.0022176383627433476, 0.0008191771550834852, 0.0))
DAHENG_LEFT = CameraInfo("daheng_left", 1.8019272106229043e03, 1.8004645266867349e03, 1.0147315383836959e03, 7.5597151164616434e02, (-1.3119230098169488e-01, 9.1329954362277616e-02, -1.3612752872624691e-03, 7.8415640338919232e-04, -1.8662647933248181e-02))


@dataclass(frozen=True)
class Pinhole:
    """A camera at a pose: rotation vector (axis times angle) and translation."""

    camera: CameraInfo
    rotation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    translation: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def at(self, rotation, translation) -> Pinhole:
        return Pinhole(self.camera, tuple(rotation), tuple(translation))

    def matrix(self) -> np.ndarray:
        """Rodrigues' formula."""
        r = np.array(self.rotation, float)
        angle = np.linalg.norm(r)
        if angle == 0:
            return np.eye(3)
        k = r / angle
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Pixel (double) of a point in camera axes; null at depth 0."""
        r = self.matrix()
        c = [sum((F.lit(float(r[i, j])) * v for j, v in enumerate((x, y, z))), F.lit(float(self.translation[i]))) for i in range(3)]
        a, b = F.try_divide(c[0], c[2]), F.try_divide(c[1], c[2])
        k1, k2, p1, p2, k3 = self.camera.distortion
        r2 = a * a + b * b
        radial = 1 + F.lit(k1) * r2 + F.lit(k2) * r2 * r2 + F.lit(k3) * r2 * r2 * r2
        u = a * radial + F.lit(2 * p1) * a * b + F.lit(p2) * (r2 + 2 * a * a)
        v = b * radial + F.lit(p1) * (r2 + 2 * b * b) + F.lit(2 * p2) * a * b
        return F.lit(self.camera.fx) * u + F.lit(self.camera.cx), F.lit(self.camera.fy) * v + F.lit(self.camera.cy)


def undistort(k: np.ndarray, d: np.ndarray, pixels: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Rays (x, y at depth 1) of distorted pixels, by fixed-point steps."""
    k1, k2, p1, p2, k3 = (*np.ravel(d), 0.0, 0.0, 0.0, 0.0, 0.0)[:5]
    start = (pixels - k[:2, 2]) / k[[0, 1], [0, 1]]
    x = start.copy()
    for _ in range(rounds):
        a, b = x[:, 0], x[:, 1]
        r2 = a * a + b * b
        bend = np.stack([2 * p1 * a * b + p2 * (r2 + 2 * a * a), p1 * (r2 + 2 * b * b) + 2 * p2 * a * b], 1)
        x = (start - bend) / (1 + r2 * (k1 + r2 * (k2 + r2 * k3)))[:, None]
    return x


def best_matrix(k: np.ndarray, d: np.ndarray, width: int, height: int, alpha: float = -1.0, grid: int = 9) -> np.ndarray:
    """The camera matrix of an undistorted image: with ``alpha`` 0 it shows no pixel without a source, with 1 all of the source; what
    lies between or beyond (the recorder's -1) goes on in a straight line.

    The inner and outer rectangle of the undistorted image come from ``grid`` x ``grid`` pixels.
    """
    v, u = np.indices((grid, grid), float)
    at = np.stack([u.ravel() * (width - 1) / (grid - 1), v.ravel() * (height - 1) / (grid - 1)], 1)
    ray = undistort(k, d, at).reshape(grid, grid, 2)
    x, y = ray[..., 0], ray[..., 1]
    inner = x[:, 0].max(), y[0].max(), x[:, -1].min(), y[-1].min()
    outer = x.min(), y.min(), x.max(), y.max()
    out = np.eye(3)
    for axis, size in enumerate((width, height)):
        ends = []
        for box in (inner, outer):
            f = (size - 1) / (box[axis + 2] - box[axis])
            ends.append((f, -f * box[axis]))
        (f0, c0), (f1, c1) = ends
        out[axis, axis], out[axis, 2] = f0 * (1 - alpha) + f1 * alpha, c0 * (1 - alpha) + c1 * alpha
    return out


def rectify_map(k: np.ndarray, d: np.ndarray, r: np.ndarray, new_k: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Source pixel (nearest) of every pixel of the rectified image; -1 where there is none."""
    v, u = np.indices((height, width), float)
    ray = np.stack([u, v, np.ones_like(u)], -1) @ np.linalg.inv(new_k[:3, :3] @ r).T
    a, b = ray[..., 0] / ray[..., 2], ray[..., 1] / ray[..., 2]
    k1, k2, p1, p2, k3 = (*np.ravel(d), 0.0, 0.0, 0.0, 0.0, 0.0)[:5]
    r2 = a * a + b * b
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    x = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
    y = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    mx, my = np.rint(k[0, 0] * x + k[0, 2]).astype(np.int64), np.rint(k[1, 1] * y + k[1, 2]).astype(np.int64)
    out = (mx < 0) | (my < 0) | (mx >= width) | (my >= height)
    return np.where(out, -1, mx), np.where(out, -1, my)


def remap(image: np.ndarray, mx: np.ndarray, my: np.ndarray, border: np.ndarray | None = None) -> np.ndarray:
    """Nearest-neighbour remap; pixels without a source keep what ``border`` holds (transparent border)."""
    out = np.zeros((*mx.shape, *image.shape[2:]), image.dtype) if border is None else border.copy()
    there = mx >= 0
    out[there] = image[my[there], mx[there]]
    return out
