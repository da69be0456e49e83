"""Stereo calibration files (OpenCV YAML) as matrices and as rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NAMES = ("K1", "K2", "D1", "D2", "R", "T", "E", "F", "R1", "R2", "P1", "P2", "Q")
_MATRIX = re.compile(r"^(\w+):\s*!!opencv-matrix\s+rows:\s*(\d+)\s+cols:\s*(\d+)\s+dt:\s*\w+\s+data:\s*\[([^\]]*)\]", re.M)


@dataclass(frozen=True)
class StereoCalibration:
    """Matrices by name, row-major, in double precision."""

    matrices: dict[str, np.ndarray]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.matrices[name]

    @classmethod
    def parse(cls, text: str) -> StereoCalibration:
        found = {n: np.array([float(v) for v in data.split(",")], float).reshape(int(r), int(c)) for n, r, c, data in _MATRIX.findall(text)}
        if missing := [n for n in NAMES if n not in found]:
            raise ValueError(f"no matrix {', '.join(missing)}")
        return cls(found)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> StereoCalibration:
        """From any path Spark can read; the file is a few kilobytes."""
        return cls.parse(spark.read.text(path, wholetext=True).first()[0])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(name, rows, cols, data)."""
        return spark.createDataFrame([(n, *m.shape, [float(v) for v in m.ravel()]) for n, m in self.matrices.items()], "name string, rows int, cols int, data array<double>")
