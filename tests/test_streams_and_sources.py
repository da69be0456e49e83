from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.operators import merge, vision
from sweepline.plans import pipelines
from sweepline.sources import messages as msg
from sweepline.sources.calibration import NAMES, StereoCalibration
from sweepline.sources.clouds import decode_clouds
from sweepline.sources.schemas import schema
from sweepline.streaming import live


def _line(rows):
    """The merge as a pair of readers: both heads held; a step discards the earlier head, then gives the new earlier one."""
    heads = {k: [r for r in rows if r[0] == k] for k in ("pc", "image")}
    out = []
    first = True
    while heads["pc"] or heads["image"]:
        a = heads["pc"][0][1] if heads["pc"] else float("inf")
        b = heads["image"][0][1] if heads["image"] else float("inf")
        k = "image" if b <= a else "pc"
        head = heads[k].pop(0)
        if not first:
            out.append((head[0], head[2]))
        first = False
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_that_of_two_readers(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for run in range(6):
        own = [(rng.choice(["pc", "image"]), rng.randint(0, 12), i) for i in range(rng.randint(0, 14))]
        rows += [(run, k, t, s) for k, t, s in own]
        want[run] = _line(own)
    df = spark.createDataFrame(rows, "run_id bigint, kind string, ts_ns bigint, seq bigint")
    got: dict = {}
    for r in merge.ordered_merge(df).orderBy("run_id", "pos").collect():
        got.setdefault(r.run_id, []).append((r.kind, r.seq))
    assert got == {k: v for k, v in want.items() if v}
    assert merge.ordered_merge(df, drop_first=False).count() == len(rows)


def test_golden_merge(spark):
    rows = [(0, "pc", t, i) for i, t in enumerate((10, 20, 30))] + [(0, "image", t, 10 + i) for i, t in enumerate((10, 25))]
    got = merge.ordered_merge(spark.createDataFrame(rows, "run_id int, kind string, ts_ns bigint, seq bigint")).orderBy("pos").collect()
    assert [(r.kind, r.ts_ns) for r in got] == [("pc", 10), ("pc", 20), ("image", 25), ("pc", 30)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 0
    for s in range(120):
        t += rng.randint(0, 2) * 1_000_000_000
        rows.append((s % 2, rng.choice(["pc", "image"]), t, s))
    df = spark.createDataFrame(rows, "run_id bigint, kind string, ts_ns bigint, seq bigint")
    for i in range(4):
        df.where(f"seq div 30 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(r, live.END, live.END_TS, 0) for r in (0, 1)], df.schema)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run_available(live.merge_stream(live.read_messages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ["run_id", "kind", "ts_ns", "seq", "pos"]
    batch = merge.ordered_merge(df)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    state = merge.latest_state(batch)
    assert sorted(map(tuple, live.latest_state(got).collect())) == sorted(map(tuple, state.collect()))


def test_late_rows_are_merged_and_told(spark, tmp_path):
    """An image that comes long after its time is not lost: it stands where it came."""
    second = 1_000_000_000
    files = [[(0, "pc", 10, 0), (0, "pc", 20, 1), (0, "pc", 100, 2), (0, "pc", 120, 3)], [(0, "image", 5, 4), (0, "image", 130, 5)], [(0, "pc", 200, 6)], [(0, live.END, live.END_TS // second, 9)]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(r, k, t * second, s) for r, k, t, s in rows], "run_id bigint, kind string, ts_ns bigint, seq bigint")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run_available(live.merge_stream(live.read_messages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.seq, r.late) for r in got] == [(1, False), (2, False), (4, True), (3, False), (5, False), (6, False)]


def _header(sec, nano):
    return ((sec, nano), "lidar")


def test_messages_are_taken_by_position(spark, tmp_path):
    rows = [(7, _header(5, 7), 2, 3, "rgb", False, 6, "oid1")]
    odd = "a long, b struct<s:struct<sec:int,nanosec:bigint>,f:string>, c bigint, d bigint, e string, f boolean, g bigint, h string"
    spark.createDataFrame(rows, odd).write.parquet(str(tmp_path / "image"))
    r = msg.decode(msg.scan(spark, str(tmp_path / "image"), "image"), "image").first()
    assert (r.ts_ns, r.frame, r.image_oid, r.height) == (5_000_000_007, "lidar", "oid1", 2)
    files = msg.image_files(msg.decode(msg.scan(spark, str(tmp_path / "image"), "image"), "image"))
    assert files.first().file_name == "" and files.first().encoding == "BGR8"
    with pytest.raises(ValueError):
        msg.scan(spark, str(tmp_path / "image"), "point_cloud2")


def test_covariance_is_padded_and_checked(spark):
    s = schema("nav_sat_fix")
    fix = lambda cov: (_header(1, 2), (1, 2), 1.0, 2.0, 3.0, cov, 0)
    got = msg.decode(spark.createDataFrame([fix([1.0, 2.0])], s), "nav_sat_fix").first().position_covariance
    assert got == [1.0, 2.0, *[0.0] * 7]
    with pytest.raises(Exception, match="at most 9"):
        msg.decode(spark.createDataFrame([fix([1.0] * 10)], s), "nav_sat_fix").collect()


def test_vehicle_state_and_dumps(spark):
    s = schema("vehicle_state")
    df = spark.createDataFrame([(_header(1, 2), (3, 4), *map(float, range(14)))], s)
    r = msg.decode(df, "vehicle_state").first()
    assert (r.ts_ns, r.timeref_ns, r.v_mps) == (1_000_000_002, 3_000_000_004, 13.0)
    assert msg.describe(spark, df).count() == len(s)
    cloud = spark.createDataFrame([(1, bytearray(b"xy"))], "k int, data binary")
    assert [x.value for x in msg.first_row(cloud, ["k"]).orderBy("pos").collect()] == ["1", "binary"]


def test_decode_reads_offsets_of_the_stride(spark):
    raw = bytearray()
    for i in range(6):
        p = bytearray(np.random.default_rng(i).bytes(32))
        p[0:12] = struct.pack("<fff", i, i + 0.5, -i)
        p[16:20] = struct.pack("<f", i * 10)
        raw += p
    df = spark.createDataFrame([(1, 2, 3, 32, raw), (2, 1, 1, 32, None), (3, 0, 5, 32, bytearray())], "frame_id bigint, height bigint, width bigint, point_step bigint, data binary")
    got = decode_clouds(df).orderBy("point_idx").collect()
    assert [(r.frame_id, r.point_idx, r.x, r.y, r.z, r.intensity) for r in got] == [(1, i, float(i), i + 0.5, float(-i), i * 10.0) for i in range(6)]
    short = spark.createDataFrame([(1, 2, 3, 32, bytearray(b"short"))], df.schema)
    with pytest.raises(Exception, match="do not hold"):
        decode_clouds(short).collect()


def test_calibration_file(spark, tmp_path):
    text = "%YAML:1.0\n---\n" + "".join(f"{n}: !!opencv-matrix\n   rows: 2\n   cols: 2\n   dt: d\n   data: [ 1., 2.5e+01,\n       {i}, -4. ]\n" for i, n in enumerate(NAMES))
    (tmp_path / "c.yaml").write_text(text)
    c = StereoCalibration.read(spark, str(tmp_path / "c.yaml"))
    assert c["K2"].tolist() == [[1.0, 25.0], [1.0, -4.0]] and c.rows(spark).count() == len(NAMES)
    with pytest.raises(ValueError):
        StereoCalibration.parse("K1: nothing")


def test_class_names_and_files(spark, tmp_path):
    (tmp_path / "names").write_text("person\nbicycle\ncar\n")
    assert [tuple(r) for r in msg.class_names(spark, str(tmp_path / "names")).collect()] == [(0, "person"), (1, "bicycle"), (2, "car")]
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.webp").write_bytes(b"xyz")
    rows = spark.createDataFrame([("a",), ("b",)], "oid string")
    got = {r.oid: r.content for r in msg.with_bytes(spark, rows, str(tmp_path / "images")).collect()}
    assert bytes(got["a"]) == b"xyz" and got["b"] is None
    msg.prepare_folder(spark, str(tmp_path / "new"))
    with pytest.raises(FileExistsError):
        msg.prepare_folder(spark, str(tmp_path / "names"))
    msg.write_images(msg.with_bytes(spark, rows, str(tmp_path / "images")).where("content is not null"), str(tmp_path / "out"), lambda c: c[::-1])
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first().content) == b"zyx"


def test_suppression_is_greedy():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 5, 5], [0, 0, 10, 10]])
    scores = np.array([0.9, 0.8, 0.7, 0.9])
    assert vision.keep_largest(boxes, scores, np.arange(4), 0.5).tolist() == [True, False, True, False]


def test_detector_runs_in_tasks(spark):
    images = spark.createDataFrame([("a", bytearray(b"1"), 100, 100)], "image_oid string, content binary, img_w int, img_h int")

    def load():
        return lambda content: np.array([[0.5, 0.5, 0.2, 0.2, 1.0, 0.1, 0.9], [0.5, 0.5, 0.2, 0.21, 1.0, 0.8, 0.1], [0.1, 0.1, 0.1, 0.1, 1.0, 0.2, 0.3]])

    got = vision.detect(images, load, 2).collect()
    assert [(r.box_id, r.class_id, r.left, r.top, r.width) for r in got] == [(0, 1, 40, 40, 20)]


def test_points_accumulate_only_when_asked(spark):
    events = spark.createDataFrame([(0, 1, 10, 0, 7), (0, 2, 20, 1, 7)], "run_id bigint, pos bigint, ts_ns bigint, pc_seq bigint, image_seq bigint")
    clouds = spark.createDataFrame([(0, 0, 0, 1.0, 1.0, 1.0, 50.0, 50.0), (0, 1, 0, 2.0, 2.0, 2.0, 51.0, 51.0), (0, 1, 1, 2.0, 2.0, 2.0, 999.0, 0.0)], "run_id bigint, seq bigint, point_idx bigint, x double, y double, z double, px double, py double")
    boxes = spark.createDataFrame([(0, 7, 3, 0, 0, 100, 100), (0, 7, 5, 0, 0, 100, 100)], "run_id bigint, seq bigint, box_id int, left int, top int, width int, height int")
    own = {r.pos: (r.box_id, len(r.lidar_points)) for r in pipelines.lidar_points(events, clouds, boxes).collect()}
    assert own == {1: (3, 1), 2: (3, 1)}
    kept = {r.pos: len(r.lidar_points) for r in pipelines.lidar_points(events, clouds, boxes, accumulate=True).collect()}
    assert kept == {1: 1, 2: 2}


def test_presets_run(spark):
    from sweepline.plans import bindings, presets

    r = pipelines.lidar(bindings.small(spark, "/root/testdata/sf0.001"), presets.WIDE)
    assert set(r.boxes.columns) >= {"frame_id", "box_id", "cluster_id"} and r.clusters.select(F.max("cluster_id")).count() == 1


def test_blob_is_scaled_and_fitted():
    image = np.arange(2 * 4 * 3, dtype=np.uint8).reshape(2, 4, 3) * 10
    blob = vision.to_blob(image, (4, 2))
    assert blob.shape == (1, 3, 2, 4) and np.allclose(blob[0, 1], image[..., 1] / 255)
    small = vision.to_blob(image, (2, 1))
    assert np.allclose(small[0, 0, 0], [image[:, :2, 0].mean() / 255, image[:, 2:, 0].mean() / 255])
    assert vision.to_blob(np.full((7, 5), 51, np.uint8)).shape == (1, 1, 416, 416)


def test_detector_gets_blobs(spark):
    images = spark.createDataFrame([("a", bytearray(range(12)), 100, 100)], "image_oid string, content binary, img_w int, img_h int")

    def load():
        return lambda blob: np.array([[0.5, 0.5, blob.shape[3] / 100, blob.shape[2] / 100, 1.0, float(blob.max() * 255 / 11), 0.0]])

    (r,) = vision.detect(images, load, 2, decode=lambda c: np.frombuffer(c, np.uint8).reshape(2, 2, 3), size=(20, 10)).collect()
    assert (r.width, r.height, r.class_id) == (20, 10, 0) and r.confidence == pytest.approx(1.0)


def test_best_matrix_shows_all_or_only_what_there_is():
    from sweepline.functions import camera
    from sweepline.plans.presets import D1, K1

    k, d = np.array(K1), np.array(D1)
    ray = camera.undistort(k, d, np.array([[100.0, 200.0], [1900.0, 1400.0]]))
    p = camera.rectify_map(k, d, np.eye(3), k, 2048, 1536)
    assert p[0].shape == (1536, 2048) and np.isfinite(ray).all()
    with_all, only = camera.best_matrix(k, d, 2048, 1536, 1.0), camera.best_matrix(k, d, 2048, 1536, 0.0)
    assert (camera.rectify_map(k, d, np.eye(3), only, 2048, 1536)[0] < 0).mean() < 0.002
    mx, my = camera.rectify_map(k, d, np.eye(3), with_all, 2048, 1536)
    assert mx[mx >= 0].min() <= 3 and mx.max() >= 2044 and my[my >= 0].min() <= 3 and my.max() >= 1532
    beyond = camera.best_matrix(k, d, 2048, 1536)
    assert np.allclose(beyond, 2 * only - with_all)
    flat = camera.best_matrix(k, np.zeros(5), 2048, 1536)
    assert np.allclose(flat, k, atol=1e-6)


def test_another_kind_ends_a_run(spark):
    rows = [(0, "pc", 10, 0), (0, "image", 11, 0), (0, "pc", 20, 1), (0, "fix", 25, 0), (0, "image", 30, 1), (1, "pc", 1, 0), (1, "image", 2, 0)]
    m = merge.until_other(merge.ordered_merge(spark.createDataFrame(rows, "run_id bigint, kind string, ts_ns bigint, seq bigint")))
    assert sorted((r.run_id, r.kind, r.ts_ns) for r in m.collect()) == [(0, "image", 11), (0, "pc", 20), (1, "image", 2)]


def test_render_against_pixels_one_by_one(spark):
    from sweepline.plans import raster

    rng = random.Random(3)
    w, h = 23, 17
    dots = [(f, i, rng.choice([None, *range(-3, 30)]), rng.randrange(-3, 25), [rng.uniform(-50, 300) for _ in range(3)]) for f in (1, 2) for i in range(150)]
    lines = [(f, k, 0, *(rng.randrange(-40, 60) for _ in range(4)), [float(k), 9.0, 255.0]) for f in (1, 3) for k in range(25)] + [(3, 99, 0, 5, 5, 5, 5, [1.0, 2.0, 3.0]), (3, 98, 0, None, 1, 2, 3, [0.0, 0.0, 0.0])]
    lines += [(3, 100, 0, -2_000_000_000, 8, 2_000_000_000, 8, [7.0, 7.0, 7.0])]
    want = {}
    for f, _, x, y, c in dots:
        image = want.setdefault(f, {})
        if x is not None and 0 <= x < w and 0 <= y < h:
            image[x, y] = [min(255, max(0, int(np.floor(v + 0.5)))) for v in c]
    for f, _, _, ax, ay, bx, by, c in sorted(lines, key=lambda r: r[1]):
        image = want.setdefault(f, {})
        if ax is None:
            continue
        if abs(bx - ax) > 1000:
            image.update({(x, ay): c for x in range(w)})
            continue
        n = max(abs(bx - ax), abs(by - ay))
        for t in range(n + 1):
            x, y = (int(np.floor(a + t * (b - a) / max(n, 1) + 0.5)) for a, b in ((ax, bx), (ay, by)))
            if 0 <= x < w and 0 <= y < h:
                image[x, y] = c
    d = spark.createDataFrame(dots, "frame_id int, point_idx int, px int, py int, colour array<double>")
    s = spark.createDataFrame(lines, "frame_id int, box_id int, side int, ax int, ay int, bx int, by int, colour array<double>")
    got = {r.frame_id: r for r in raster.render(d, s, w, h).collect()}
    assert set(got) == set(want)
    for f, image in want.items():
        whole = np.zeros((h, w, 3), np.uint8)
        for (x, y), c in image.items():
            whole[y, x] = c
        assert bytes(got[f].content) == whole.tobytes() and got[f].n_drawn == len(image)
    assert raster.render(d.limit(0), s.limit(0), w, h).count() == 0


def test_frames_are_written_in_the_order_of_play(spark, tmp_path, capsys):
    fused = spark.createDataFrame([(r, p, 2 * p, p) for r in (1, 0) for p in (9, 4, 6)], "run_id bigint, pos bigint, pc_seq bigint, image_seq bigint")
    frames = merge.video_frames(fused, 25).withColumn("content", F.lit(b"abc"))
    msg.write_frames(frames, str(tmp_path / "frames"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "frames")).orderBy("run_id", "frame_seq").select("run_id", "pos", "frame_seq", "show_ns").collect()]
    assert rows == [(r, p, k, 40_000_000 * k) for r in (0, 1) for k, p in enumerate((4, 6, 9))]
    capsys.readouterr()
    msg.dump(frames, ["run_id", "pos"], 2)
    shown = capsys.readouterr().out
    assert "<3 bytes>" in shown and shown.count("|0 ") >= 2
