"""The four-point cloud and the small goldens."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.functions import boxes as box
from sweepline.functions import draw, geo, points
from sweepline.functions.camera import CameraInfo, Pinhole, project, rectify_map, remap, rig
from sweepline.operators import clouds, cluster, neighbors, plane
from sweepline.plans import pipelines, presets

FOUR = [(0, 0, -6.2, 7.1, 0.0, 0.0), (0, 1, -6.3, 8.4, 0.0, 0.0), (0, 2, -5.2, 7.1, 0.0, 0.0), (0, 3, -5.7, 6.3, 0.0, 0.0)]
SCHEMA = "frame_id bigint, point_idx bigint, x double, y double, z double, intensity double"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(FOUR, SCHEMA).cache()


def test_box_of_cloud(four):
    r = clouds.extents(four).withColumn("d", box.diagonal()).first()
    assert (r.xmin, r.ymin, r.zmin, r.xmax, r.ymax, r.zmax) == (-6.3, 6.3, 0.0, -5.2, 8.4, 0.0)
    assert r.d == pytest.approx(2.3707, abs=1e-4)


def test_inside_is_inclusive_and_nan_is_outside(spark, four):
    rows = spark.createDataFrame([(-6.0, 7.0, 0.0), (-6.4, 7.0, 0.0), (-6.3, 6.3, 0.0), (float("nan"), 7.0, 0.0), (None, 7.0, 0.0)], "x double, y double, z double")
    got = [r[0] for r in rows.select(points.inside((-6.3, 6.3, 0.0), (-5.2, 8.4, 0.0))).collect()]
    assert got == [True, False, True, False, False]
    assert clouds.crop(rows, (-6.3, 6.3, 0.0), (-5.2, 8.4, 0.0), drop=True).count() == 3


def test_wireframe_has_twelve_edges(four):
    lines = clouds.extents(four).select(F.inline(box.wireframe())).collect()
    assert len(lines) == 12 == len({r.edge for r in lines})
    for r in lines:  # an edge runs along one axis
        assert sum(a != b for a, b in ((r.ax, r.bx), (r.ay, r.by), (r.az, r.bz))) <= 1


def test_radius_search(four):
    found = neighbors.radius_search(four.where("point_idx = 1"), four, 1.75)
    assert sorted(r.neighbour_idx for r in found.collect()) == [0, 1, 2]


def test_distances(four):
    d = {(r.target_idx, r.neighbour_idx): r.dist for r in neighbors.radius_search(four, four, 10.0).collect()}
    for k, v in {(0, 1): 1.3038, (0, 2): 1.0, (0, 3): 0.9434, (1, 2): 1.7029, (1, 3): 2.1840, (2, 3): 0.9434}.items():
        assert d[k] == pytest.approx(v, abs=1e-4)


def test_clusters(four):
    rows = cluster.clusters(four, 0.95, 2, 4).collect()
    assert {(r.cluster_id, r.point_idx) for r in rows} == {(0, 0), (0, 2), (0, 3)}
    other = cluster.components(four, 0.95, 2).collect()
    assert {(r.cluster_id, r.point_idx) for r in other} == {(0, 0), (0, 2), (0, 3)}


def _queue_growth(xyz, tol, least, most):
    """The rule in plain words: who is visited joins; who joins a cluster that is not full yet has its neighbours wait, too."""
    label, used, number = [-1] * len(xyz), set(), 0
    for seed in range(len(xyz)):
        if seed in used:
            continue
        members, waiting = [], [seed]
        while waiting:
            p = waiting.pop(0)
            if p in used:
                continue
            used.add(p)
            members.append(p)
            if len(members) < most:
                waiting += [q for q in range(len(xyz)) if math.dist(xyz[p], xyz[q]) < tol]
        if len(members) >= least:
            for p in members:
                label[p] = number
            number += 1
    return label


def test_size_limit_is_soft():
    line = np.c_[np.arange(10.0), np.zeros(10), np.zeros(10)]
    assert cluster.grow(line, 1.5, 1, 4).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    star = np.array([[0.0, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]])
    assert cluster.grow(star, 1.1, 1, 3).tolist() == [0] * 7  # those that wait when it is full still join
    rng = np.random.default_rng(4)
    for n, tol, least, most in ((60, 1.5, 2, 5), (150, 2.0, 3, 10), (150, 1.2, 1, 1), (90, 9.0, 7, 150)):
        cloud = rng.uniform(-5, 5, (n, 3))
        assert cluster.grow(cloud, tol, least, most).tolist() == _queue_growth(cloud.tolist(), tol, least, most)
        assert cluster.grow(cloud, tol, least, None).tolist() == _queue_growth(cloud.tolist(), tol, least, n + 1)
    odd = np.array([[0.0, 0, 0], [np.nan, 0, 0], [0.5, 0, 0], [np.inf, 0, 0]])
    assert cluster.grow(odd, 1.0, 1, None).tolist() == [0, 1, 0, 2] == cluster.grow(odd, 1.0, 1, 5).tolist()


def test_points_equal_to_a_sample_are_on_the_plane(spark):
    """All samples coincide: the plane is none, but every point with the sample's values counts."""
    p = spark.createDataFrame([(0, i, 1.0, 2.0, 3.0, 4.0) for i in range(5)], SCHEMA)
    assert plane.segment(p, 3, 0.1).where("is_inlier").count() == 5


def test_samples_differ_from_iteration_to_iteration(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(f, i, *map(float, rng.normal(size=4))) for f in (0, 1) for i in range(200)], SCHEMA)
    got = plane.candidates(p, 60).collect()
    triples = {(r.frame_id, r.s1, r.s2, r.s3) for r in got}
    assert len(got) == 120 and len(triples) > 115 and len({(r.s2 - r.s1) % 200 for r in got}) > 50
    assert len({r.s1 for r in got}) > 60


def test_voxel_grid_golden(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.1, 0.1, 0.1, 2.0), (1.0, 1.0, 1.0, 3.0), (4.0, 4.0, 4.0, 4.0), (3.9, 3.9, 3.9, 5.0)]
    p = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = clouds.voxel_grid(p, (2, 2, 2)).orderBy("point_idx").collect()
    assert [r.box_idx for r in got] == [26, 13, 0]
    assert [r.intensity for r in got] == [4.0, 5.0, 3.0]
    assert got[2].x == pytest.approx(1.1 / 3)


def test_flat_and_empty_clouds(spark, four):
    assert clouds.voxel_grid(four, (10, 10, 10)).count() > 0
    empty = four.where("false")
    assert clouds.voxel_grid(empty, (2, 2, 2)).count() == 0 == cluster.clusters(empty, 1.0).count() == plane.segment(empty, 3, 1.0).count()


def test_nan_takes_no_part_in_extents(spark):
    p = spark.createDataFrame([(0, 0, 1.0, float("nan"), 0.0, 0.0), (0, 1, 2.0, 5.0, 0.0, 0.0)], SCHEMA)
    assert clouds.extents(p).first().ymax == 5.0


def test_difference_removes_all_copies_but_never_nan(spark):
    nan = float("nan")
    p = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0, 1.0), (0, 2, nan, 1.0, 1.0, 1.0)], SCHEMA)
    assert [r.point_idx for r in clouds.difference(p, p.where("point_idx in (0, 2)")).collect()] == [2]


def test_plane_is_found(spark):
    rng = np.random.default_rng(3)
    flat = np.c_[rng.uniform(-10, 10, (80, 2)), rng.normal(0, 0.01, 80)]
    high = rng.uniform(2, 9, (20, 3))
    p = spark.createDataFrame([(1, i, *map(float, r), 0.0) for i, r in enumerate(np.r_[flat, high])], SCHEMA)
    got = plane.segment(p, 40, 0.2)
    assert got.where("is_inlier").count() >= 80
    assert got.where("is_inlier and point_idx >= 80").count() <= 2
    assert plane.segment(p, 0, 0.2).where("is_inlier").count() == 0


def test_left_projection_golden(spark):
    m = rig(presets.calibration(), "left")
    assert m[2] == pytest.approx([0.999946791, -0.009016660, 0.005011428, -0.112113287], abs=1e-9)
    p = spark.createDataFrame([(8.266552, 3.1580696, -0.69036144)], "x double, y double, z double")
    u, v, depth = p.select(*project(m, F.col("x"), F.col("y"), F.col("z"))).first()
    assert (u, v, depth) == (pytest.approx(544.5325, abs=1e-3), pytest.approx(864.6614, abs=1e-3), pytest.approx(8.1221, abs=1e-4))


def test_pinhole_without_distortion(spark):
    cam = Pinhole(CameraInfo("c", 100.0, 200.0, 10.0, 20.0, (0.0,) * 5)).at((0.0, 0.0, math.pi / 2), (0.0, 0.0, 1.0))
    u, v = spark.range(1).select(*cam.project(F.lit(1.0), F.lit(0.0), F.lit(1.0))).first()
    assert (u, v) == (pytest.approx(10.0), pytest.approx(120.0))


def test_rectify_identity_and_border():
    k = np.array([[50.0, 0, 8], [0, 50.0, 6], [0, 0, 1]])
    mx, my = rectify_map(k, np.zeros(5), np.eye(3), k, 16, 12)
    image = np.arange(12 * 16 * 3, dtype=np.uint8).reshape(12, 16, 3)
    assert np.array_equal(remap(image, mx, my), image)
    moved = k.copy()
    moved[0, 2] += 4
    mx, my = rectify_map(k, np.zeros(5), np.eye(3), moved, 16, 12)
    out = remap(image, mx, my)
    assert np.array_equal(out[:, 4:], image[:, :-4]) and not out[:, :4].any()


def test_batch_rectify(spark):
    k = np.array([[50.0, 0, 2], [0, 50.0, 2], [0, 0, 1]])
    rows = spark.createDataFrame([("a", bytearray(range(16))), ("b", None)], "oid string, content binary")
    out = pipelines.rectify(rows, k, np.zeros(5), np.eye(3), k, (4, 4), lambda c: np.frombuffer(c, np.uint8).reshape(4, 4), lambda i: i.tobytes())
    assert [(r.oid, bytes(r.content)) for r in out.collect()] == [("a", bytes(range(16)))]


def test_shrunk_box(spark):
    b = spark.createDataFrame([(10, 20, 101, 51)], "left int, top int, width int, height int")
    assert tuple(b.select(*box.shrunk(0.1)).first()) == (15, 22, 90, 45)
    small = b.select(*(c.alias(n) for c, n in zip(box.shrunk(0.1), b.columns, strict=True)))
    inside = lambda x, y: small.select(box.contains(F.lit(x), F.lit(y))).first()[0]
    assert inside(15, 22) and inside(104, 66) and not inside(105, 22)


def test_top_view(spark):
    assert tuple(spark.range(1).select(*draw.top_view(F.lit(10.0), F.lit(2.0))).first()) == (50.0, 200.0)


def test_sort_and_hash_keys(spark):
    p = spark.createDataFrame([(0, 0, 0.0011, 0.0, 0.0, 0.19), (0, 1, 0.0012, 0.0, 0.0, None), (0, 2, 0.0, 0.0, 0.0, 5.0)], SCHEMA)
    assert [r.point_idx for r in p.orderBy(*points.sort_key()).collect()] == [2, 1, 0]
    h = [r[0] for r in p.select(points.hash_key()).collect()]
    assert h[0] != h[2]


def test_geodesy_round_figures(spark):
    one = spark.range(1)
    x, y, z = one.select(*geo.ecef(F.lit(0.0), F.lit(90.0), F.lit(0.0))).first()
    assert (x, y, z) == (pytest.approx(0, abs=1e-6), pytest.approx(6378137.0), pytest.approx(0, abs=1e-6))
    e, n, u = one.select(*geo.enu(F.lit(52.5), F.lit(13.4), F.lit(44.0), (52.5, 13.4, 34.0))).first()
    assert (e, n, u) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6), pytest.approx(10, abs=1e-6))
    n, e, d = one.select(*geo.ned(F.lit(52.501), F.lit(13.4), F.lit(34.0), (52.5, 13.4, 34.0))).first()
    assert 111 < n < 112 and abs(e) < 1e-6 and d > 0
