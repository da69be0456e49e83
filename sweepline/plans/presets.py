"""Parameters of the known recordings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..sources.calibration import StereoCalibration

# Camera matrices, distortion, rectifying rotations and projections of the stereo pair (row-major).
K1 = ((1.1979317325590257e03, 0.0, 1.0013367907932070e03), (0.0, 1.1964248804687504e03, 7.7570747435916758e02), (0.0, 0.0, 1.0))
K2 = ((1.2030567062950474e03, 0.0, 1.0299494377391586e03), (0.0, 1.2020864207044103e03, 7.6621576519029861e02), (0.0, 0.0, 1.0))
D1 = ((-9.3277366817968110e-02, 9.0227117308615323e-02, 1.3731944067915975e-03, -2.6950252581841092e-04, -1.1276592181033412e-02),)
D2 = ((-9.4148811167140994e-02, 9.4648137061469448e-02, 2.4497184996626399e-03, -1.0105394635706477e-04, -1.0699945144615202e-02),)
R1 = ((9.9996380719634492e-01, 2.3718346559601497e-04, 8.5045894312790055e-03), (-1.9453968960900797e-04, 9.9998740746909409e-01, -5.0146841923709240e-03), (-8.5056717371493635e-03, 5.0128482167023456e-03, 9.9995126126279565e-01))
R2 = ((9.9995922671740134e-01, 5.3992185283634154e-04, -9.0140660708465450e-03), (-4.9471977683748639e-04, 9.9998729695379085e-01, 5.0160924426855694e-03), (9.0166598626743675e-03, -5.0114284833758932e-03, 9.9994679129915531e-01))
P1 = ((1.1992556505865805e03, 0.0, 9.8470756530761719e02, 0.0), (0.0, 1.1992556505865805e03, 7.7493472290039062e02, 0.0), (0.0, 0.0, 1.0, 0.0))
P2 = ((1.1992556505865805e03, 0.0, 1.0476866607666016e03, -5.9411823508132971e05), (0.0, 1.1992556505865805e03, 7.7493472290039062e02, 0.0), (0.0, 0.0, 1.0, 0.0))


def calibration() -> StereoCalibration:
    """The matrices that projection and rectification use."""
    return StereoCalibration({n: np.array(m, float) for n, m in (("K1", K1), ("K2", K2), ("D1", D1), ("D2", D2), ("R1", R1), ("R2", R2), ("P1", P1), ("P2", P2))})


@dataclass(frozen=True)
class LidarPipeline:
    """Voxel grid, crops, plane and clusters of a LiDAR frame."""

    leaves: tuple[int, int, int] = (2000, 1200, 800)
    keep: tuple[tuple, tuple] = ((-50.0, -12.0, -4.75), (50.0, 12.0, 3.0))
    drop: tuple[tuple, tuple] | None = ((-2.5, -0.75, -1.0), (1.0, 0.75, 0.2))
    iterations: int = 50
    plane_limit: float = 0.35
    tol: float = 1.25
    least: int = 7
    most: int | None = 150


DRIVE = LidarPipeline()
WIDE = LidarPipeline((1000, 1000, 100), ((-120.0, -5.0, -4.75), (120.0, 5.0, 2.0)), None, 10, 0.5, 10.0, 20, 200)
IMAGE_SIZE, FRAME_RATE, WEBP_QUALITY = (2048, 1536), 50, 70
