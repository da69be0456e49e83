"""Binary point-cloud payloads: little-endian float32 x, y, z, intensity at bytes 0, 4, 8, 16 of each stride."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OFFSETS = (0, 4, 8, 16)
SMALLEST_STEP = 20


def _layout(step: int) -> np.dtype:
    return np.dtype({"names": ["x", "y", "z", "intensity"], "formats": ["<f4"] * 4, "offsets": list(OFFSETS), "itemsize": step})


def decode_clouds(clouds: DataFrame, frame: str = "frame_id") -> DataFrame:
    """(frame_id, point_idx, x, y, z, intensity): height * width points of each payload, exploded.

    A payload shorter than its points, or a step under 20 bytes, is an error; null payloads give no point.
    """

    def run(batches):
        for batch in batches:
            for f, h, w, step, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                if not data.is_valid:
                    continue
                n, step = h.as_py() * w.as_py(), step.as_py()
                raw = data.as_buffer()
                if n and (step < SMALLEST_STEP or len(raw) < n * step):
                    raise ValueError(f"{len(raw)} bytes do not hold {n} points of {step} bytes")
                p = np.frombuffer(raw, _layout(step), n) if n else np.zeros(0, _layout(SMALLEST_STEP))
                cols = [pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(p[c])) for c in p.dtype.names)]
                yield pa.RecordBatch.from_arrays([pa.repeat(f, n), *cols], ["frame_id", "point_idx", "x", "y", "z", "intensity"])

    kind = clouds.schema[frame].dataType.simpleString()
    return clouds.select(frame, "height", "width", "point_step", "data").mapInArrow(run, f"frame_id {kind}, point_idx bigint, x float, y float, z float, intensity float")


def encode_clouds(points: DataFrame, step: int = 32) -> DataFrame:
    """(frame_id, height, width, point_step, data): the payload of each frame, points in point_idx order."""

    def run(key, t):
        order = np.argsort(t["point_idx"].to_numpy(), kind="stable")
        n = len(order)
        raw = np.full(n * step, 0xA5, np.uint8).view(_layout(step))  # what stands between the fields must not matter
        for c in ("x", "y", "z", "intensity"):
            raw[c] = t[c].to_numpy()[order]
        return pa.table({"frame_id": t["frame_id"].slice(0, 1), "height": [1], "width": [n], "point_step": [step], "data": pa.array([raw.tobytes()], pa.binary())})

    kind = points.schema["frame_id"].dataType.simpleString()
    return points.groupBy("frame_id").applyInArrow(run, f"frame_id {kind}, height bigint, width bigint, point_step bigint, data binary")
