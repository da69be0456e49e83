"""Registered queries and their DuckDB counterparts.

Real numbers are put on a grid (``_q`` here, ``_s`` in SQL) before they are compared: floor(v * 10^d + offset) / 10^d, with an
offset that keeps decimal fractions off the edges of the grid, so that the order of a sum cannot matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as box
from ..functions import draw, geo, points
from ..functions.camera import DAHENG_LEFT, Pinhole, rig
from ..operators import clouds, cluster, merge, neighbors, plane, vision
from ..operators import boxes as lidar_boxes
from ..sources.clouds import decode_clouds, encode_clouds
from ..sources.calibration import NAMES, StereoCalibration
from ..sources.merged import points_of, scan_clouds, scan_merged
from ..sources.messages import class_names, decode, describe, image_files, run_paths, scan, with_bytes
from ..storage import cut, drop, new_folder, put_bytes
from ..streaming import live
from . import bindings as b
from . import pipelines, raster
from .presets import LidarPipeline, calibration

OFFSET = 0.31830988618
QUERIES: dict = {}
ORACLES: dict = {}


def _q(c: Column | str, d: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(float(10**d)) + F.lit(OFFSET)).cast("double") / F.lit(float(10**d))


def _s(e: str, d: int = 4) -> str:
    return f"floor(({e}) * {10**d}::DOUBLE + {OFFSET}::DOUBLE) / {10**d}::DOUBLE"


def _sq(names: list[str], d: int = 4) -> str:
    return ", ".join(f"{_s(n, d)} AS {n}" for n in names)


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BOX = ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"]
_EXTENTS = ", ".join(f"{f}({c}) AS {c}{f}" for f in ("min", "max") for c in "xyz")


# ---------------------------------------------------------------- voxel grid in SQL
def _voxel_sql(source: str, leaves, intensity: str = "arg_max(intensity, point_idx)", name: str = "v") -> str:
    """CTEs p, e, g and ``name``: cells of a cloud."""
    dims = dict(zip("xyz", leaves, strict=True))
    inv = ", ".join(f"CASE WHEN ({c}max - {c}min) / {n}::DOUBLE > 0 THEN 1.0::DOUBLE / (({c}max - {c}min) / {n}::DOUBLE) END AS i{c}" for c, n in dims.items())
    low = ", ".join(f"i{c}, floor({c}min * i{c}) AS o{c}, coalesce(ceil({c}max * i{c}) - floor({c}min * i{c}) + 1, 1) AS d{c}" for c in "xyz")
    cell = [f"coalesce(floor({c} * i{c} - o{c}), 0)" for c in "xyz"]
    return f"""p AS ({source}), e AS (SELECT frame_id, {_EXTENTS} FROM p GROUP BY frame_id), i AS (SELECT *, {inv} FROM e),
 g AS (SELECT frame_id, {low} FROM i), c AS (SELECT p.*, CAST({cell[0]} + {cell[1]} * dx + {cell[2]} * dx * dy AS BIGINT) AS box_idx FROM p JOIN g USING (frame_id)),
 {name} AS (SELECT frame_id, box_idx, avg(x) AS x, avg(y) AS y, avg(z) AS z, {intensity} AS intensity, count(*) AS n_points FROM c GROUP BY frame_id, box_idx)"""


LEAVES = (20, 15, 10)
LOW, HIGH = (5.0, 5.0, 1.0), (45.0, 60.0, 8.0)


def _inside_sql(low, high) -> str:
    return " AND ".join(f"{c} BETWEEN {a} AND {z}" for c, a, z in zip("xyz", low, high, strict=True))


@query(f"WITH {_voxel_sql(b.LARGE_SQL, LEAVES)} SELECT frame_id, count(*) AS n, {', '.join(f'{_s(f'{f}({c})')} AS {c}{f}' for f in ('min', 'max') for c in 'xyz')} FROM v WHERE {_inside_sql(LOW, HIGH)} GROUP BY frame_id")
def flagship(spark, d) -> DataFrame:
    """Voxel grid, crop, count and box of each frame."""
    cells = clouds.voxel_grid(b.large(spark, d), LEAVES, number=False)
    e = clouds.crop(cells, LOW, HIGH).groupBy("frame_id").agg(F.count("*").alias("n"), *(_q(f(c)).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))
    return e


@query(f"WITH p AS ({b.LARGE_SQL}) SELECT frame_id, {_EXTENTS} FROM p GROUP BY frame_id")
def point_minmax(spark, d) -> DataFrame:
    return clouds.extents(b.large(spark, d))


@query(f"WITH {_voxel_sql(b.LARGE_SQL, LEAVES)} SELECT frame_id, box_idx, {_sq(['x', 'y', 'z', 'intensity'])}, n_points, row_number() OVER (PARTITION BY frame_id ORDER BY box_idx DESC) - 1 AS point_idx FROM v")
def voxel_downsample(spark, d) -> DataFrame:
    v = clouds.voxel_grid(b.large(spark, d), LEAVES)
    return v.select("frame_id", "box_idx", *(_q(c).alias(c) for c in ("x", "y", "z", "intensity")), "n_points", "point_idx")


@query(f"WITH {_voxel_sql(b.LARGE_SQL, (8, 8, 4), 'avg(intensity)')} SELECT frame_id, box_idx, {_sq(['x', 'y', 'z', 'intensity'])}, n_points FROM v")
def voxel_downsample_mean(spark, d) -> DataFrame:
    v = clouds.voxel_grid(b.large(spark, d), (8, 8, 4), "mean", number=False)
    return v.select("frame_id", "box_idx", *(_q(c).alias(c) for c in ("x", "y", "z", "intensity")), "n_points")


_CROP = ((10.0, 20.0, 2.0), (30.0, 70.0, 6.0))


@query(f"WITH p AS ({b.LARGE_SQL}) SELECT * FROM p WHERE {_inside_sql(*_CROP)}")
def crop_keep(spark, d) -> DataFrame:
    return clouds.crop(b.large(spark, d), *_CROP)


@query(f"WITH p AS ({b.LARGE_SQL}) SELECT frame_id, count(*) AS n, min(point_idx) AS first_idx FROM p WHERE NOT ({_inside_sql(*_CROP)}) GROUP BY frame_id")
def crop_drop(spark, d) -> DataFrame:
    return clouds.crop(b.large(spark, d), *_CROP, drop=True).groupBy("frame_id").agg(F.count("*").alias("n"), F.min("point_idx").alias("first_idx"))


@query(f"WITH p AS ({b.SMALL_SQL}) SELECT * FROM p WHERE x > 0 AND abs(atan2(y, x)) < radians(45)")
def fov_filter(spark, d) -> DataFrame:
    return b.small(spark, d).where(points.ahead())


@query(f"""WITH p AS ({b.SMALL_SQL}) SELECT frame_id, point_idx, CAST(trunc(sqrt(x * x + y * y + z * z) * 1000) AS BIGINT) AS millimetres, CAST(trunc(intensity * 10) AS BIGINT) AS tenths,
 row_number() OVER (PARTITION BY frame_id ORDER BY trunc(sqrt(x * x + y * y + z * z) * 1000), trunc(intensity * 10), point_idx) - 1 AS place FROM p""")
def point_sort_key(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("frame_id").orderBy(*points.sort_key(), "point_idx")
    return b.small(spark, d).select("frame_id", "point_idx", points.scaled(points.norm(), 1000).alias("millimetres"), points.scaled(F.col("intensity"), 10).alias("tenths"), (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query(f"WITH p AS ({b.SMALL_SQL}) SELECT frame_id, point_idx, {_s('sqrt(x * x + y * y + z * z)')} AS norm, {_s('sqrt((x - 1) * (x - 1) + (y + 2) * (y + 2) + (z - 3) * (z - 3))')} AS dist, coalesce(intensity, 0) AS payload, [x, y, z] = [x, y, z] AS same FROM p")
def point_metrics(spark, d) -> DataFrame:
    p = b.small(spark, d)
    far = points.distance(F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.lit(-2.0), F.lit(3.0))
    return p.select("frame_id", "point_idx", _q(points.norm()).alias("norm"), _q(far).alias("dist"), points.payload().alias("payload"), (points.xyz() == points.xyz()).alias("same"))


@query(f"WITH p AS ({b.LARGE_SQL}) SELECT frame_id, x, y, z, intensity, min(point_idx) AS point_idx FROM p GROUP BY ALL")
def distinct_points(spark, d) -> DataFrame:
    return clouds.distinct_points(b.large(spark, d))


@query(f"WITH p AS ({b.LARGE_SQL}), o AS (SELECT DISTINCT frame_id, x, y, z, intensity FROM p WHERE point_idx % 3 = 0) SELECT p.frame_id, p.point_idx FROM p ANTI JOIN o USING (frame_id, x, y, z, intensity)")
def cloud_difference(spark, d) -> DataFrame:
    p = b.large(spark, d)
    return clouds.difference(p, p.where("point_idx % 3 = 0")).select("frame_id", "point_idx")


# ---------------------------------------------------------------- boxes
_BOXES = f"p AS ({b.SMALL_SQL}), bb AS (SELECT frame_id, point_idx % 7 AS cluster_id, {_EXTENTS} FROM p GROUP BY 1, 2)"


def _small_boxes(spark, d) -> DataFrame:
    p = b.small(spark, d).withColumn("cluster_id", F.col("point_idx") % 7)
    return clouds.bounding_boxes(p).drop("n_points")


@query(f"WITH {_BOXES} SELECT frame_id, cluster_id, {_s('sqrt((xmin - xmax) * (xmin - xmax) + (ymin - ymax) * (ymin - ymax) + (zmin - zmax) * (zmin - zmax))')} AS diagonal, {_s('xmax - xmin')} AS dx, {_s('ymax - ymin')} AS dy, {_s('zmax - zmin')} AS dz FROM bb")
def box_metrics(spark, d) -> DataFrame:
    dx, dy, dz = box.extents()
    return _small_boxes(spark, d).select("frame_id", "cluster_id", _q(box.diagonal()).alias("diagonal"), _q(dx).alias("dx"), _q(dy).alias("dy"), _q(dz).alias("dz"))


def _wireframe_sql() -> str:
    low, high = [f"{a}min" for a in "yzx"], [f"{a}max" for a in "yzx"]
    corner = {k: [high[i] if k >> i & 1 else low[i] for i in range(3)] for k in range(8)}
    pairs = [(a, a | 1 << i) for a in range(8) for i in range(3) if not a >> i & 1]
    return " UNION ALL ".join(f"SELECT frame_id, cluster_id, {e} AS edge, {', '.join(f'{c} AS {n}' for n, c in zip(('ax', 'ay', 'az', 'bx', 'by', 'bz'), corner[x] + corner[y], strict=True))} FROM bb" for e, (x, y) in enumerate(pairs))


@query(f"WITH {_BOXES} {_wireframe_sql()}")
def box_wireframe(spark, d) -> DataFrame:
    return _small_boxes(spark, d).select("frame_id", "cluster_id", F.inline(box.wireframe()))


_RULE = lidar_boxes.Plausible(-30.0, 30.0, (0.3, 40.0), (0.3, 40.0), (0.2, 30.0))
_RULE_SQL = "zmin >= -30 AND zmax <= 30 AND xmax - xmin BETWEEN 0.3 AND 40 AND ymax - ymin BETWEEN 0.3 AND 40 AND zmax - zmin BETWEEN 0.2 AND 30"
_NUMBERED = f"{_BOXES}, nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY cluster_id) - 1 AS INTEGER) AS box_id FROM bb WHERE {_RULE_SQL})"


@query(f"WITH {_NUMBERED} SELECT * FROM nb")
def plausible_boxes(spark, d) -> DataFrame:
    return lidar_boxes.plausible(_small_boxes(spark, d), _RULE)


@query(f"WITH {_BOXES}, s AS (SELECT * REPLACE (ymin - 20 AS ymin, ymax - 20 AS ymax) FROM bb) SELECT * FROM s WHERE NOT (zmin >= -5 AND zmax <= 15 AND xmax - xmin BETWEEN 0.3 AND 20 AND ymax - ymin BETWEEN 0.3 AND 20 AND zmax - zmin BETWEEN 0.2 AND 15) AND xmax > 0 AND ymax < 8")
def rejected_boxes(spark, d) -> DataFrame:
    """A narrow rule turns many boxes down; they are moved to the near side."""
    rule = lidar_boxes.Plausible(-5.0, 15.0, (0.3, 20.0), (0.3, 20.0), (0.2, 15.0))
    moved = _small_boxes(spark, d).withColumns({"ymin": F.col("ymin") - 20, "ymax": F.col("ymax") - 20})
    return lidar_boxes.rejected_nearby(moved, rule)


_AHEAD = "xmin > -25 AND xmin < 0"
_Y = "(CASE WHEN ymin < 0 THEN ymax ELSE ymin END)"


@query(f"WITH {_NUMBERED}, s AS (SELECT frame_id, box_id, cluster_id, xmin + 25 AS xmin, ymin, zmin, xmax + 25 AS xmax, ymax, zmax FROM nb), f AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS r FROM s WHERE xmin > 0 AND xmin < 25 AND {_Y} > -15 AND {_Y} < 15) SELECT * EXCLUDE (r) FROM f WHERE r = 1")
def ego_front(spark, d) -> DataFrame:
    s = lidar_boxes.plausible(_small_boxes(spark, d), _RULE).withColumns({"xmin": F.col("xmin") + 25, "xmax": F.col("xmax") + 25})
    return lidar_boxes.ego_front(s, side=15.0)


# ---------------------------------------------------------------- merge
def _merge_sql(ts: str) -> str:
    return f"""m AS ({b.MESSAGES_SQL.format(ts=ts)}), r AS (SELECT *, max(ts_ns) OVER (PARTITION BY run_id, kind ORDER BY seq) AS eff FROM m),
 n AS (SELECT run_id, kind, ts_ns, seq, row_number() OVER (PARTITION BY run_id ORDER BY eff, CASE WHEN kind = 'image' THEN 0 ELSE 1 END, seq) - 2 AS pos FROM r), mg AS (SELECT * FROM n WHERE pos >= 0)"""


_STATE = """ls AS (SELECT run_id, pos, ts_ns, last_value(CASE WHEN kind = 'pc' THEN seq END IGNORE NULLS) OVER w AS pc_seq, last_value(CASE WHEN kind = 'image' THEN seq END IGNORE NULLS) OVER w AS image_seq
 FROM mg WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), fu AS (SELECT * FROM ls WHERE pc_seq IS NOT NULL AND image_seq IS NOT NULL)"""


@query("SELECT event_id AS seq, value AS range_m, NULL::VARCHAR AS oid, 'pc' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, CAST(user_id AS VARCHAR), 'image' FROM events WHERE event_type = 'click'")
def tagged_union(spark, d) -> DataFrame:
    e = b.table(spark, d, "events")
    clouds_ = e.where("event_type = 'view'").selectExpr("event_id AS seq", "value AS range_m")
    return merge.tagged_union(pc=clouds_, image=e.where("event_type = 'click'").selectExpr("event_id AS seq", "cast(user_id AS string) AS oid"))


@query(f"WITH {_merge_sql(b.EXACT_TS)} SELECT * FROM mg")
def msg_merge(spark, d) -> DataFrame:
    return merge.ordered_merge(b.messages(spark, d))


@query(f"WITH {_merge_sql(b.DAY_TS)} SELECT * FROM mg")
def msg_merge_ties(spark, d) -> DataFrame:
    return merge.ordered_merge(b.messages(spark, d, by_day=True))


@query(f"WITH {_merge_sql(b.EXACT_TS)}, {_STATE} SELECT * FROM fu")
def latest_state_join(spark, d) -> DataFrame:
    return merge.latest_state(merge.ordered_merge(b.messages(spark, d)))


_SHUFFLED = "CASE WHEN seq % 17 = 0 THEN seq * 2 - 61 ELSE seq * 2 END"


@query(f"WITH m AS (SELECT run_id, kind, ts_ns, {_SHUFFLED} AS seq FROM ({b.MESSAGES_SQL.format(ts=b.EXACT_TS)})), l AS (SELECT *, lag(ts_ns) OVER (PARTITION BY run_id, kind ORDER BY seq) AS prev_ts_ns FROM m) SELECT * FROM l WHERE ts_ns < prev_ts_ns")
def out_of_order(spark, d) -> DataFrame:
    """One message in seventeen was written thirty places before its time."""
    return merge.out_of_order(b.messages(spark, d).withColumn("seq", F.expr(_SHUFFLED)))


@query(f"WITH {_merge_sql(b.EXACT_TS)}, {_STATE} SELECT run_id, pos, pos AS newest, lag(pos) OVER (PARTITION BY run_id ORDER BY pos) AS older FROM fu")
def last_two_frames(spark, d) -> DataFrame:
    two = merge.last_two(merge.latest_state(merge.ordered_merge(b.messages(spark, d))))
    return two.select("run_id", "pos", F.element_at("recent", -1).alias("newest"), F.when(F.size("recent") == 2, F.col("recent")[0]).alias("older"))


@query(f"WITH m AS ({b.MESSAGES_SQL.format(ts=b.EXACT_TS)}) SELECT kind, count(*) AS n FROM m GROUP BY kind")
def kind_counts(spark, d) -> DataFrame:
    return clouds.kind_counts(b.messages(spark, d))


# ---------------------------------------------------------------- neighbours, planes, clusters
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH p AS ({b.SMALL_SQL}) SELECT a.frame_id, a.point_idx AS target_idx, b.point_idx AS neighbour_idx, {_s(_DIST)} AS dist FROM p a JOIN p b ON a.frame_id = b.frame_id AND {_DIST} < 5")
def radius_search(spark, d) -> DataFrame:
    p = b.small(spark, d)
    return neighbors.radius_search(p, p, 5.0).withColumn("dist", _q("dist"))


ITERATIONS, LIMIT = 10, 2.5


def _plane_sql(cloud: str, iterations: int, limit: float) -> str:
    """CTEs over a relation ``cloud``: planes, their support, the best one (bp) and the points with is_inlier (sg)."""
    v = {k: [f"(p{k}.{c} - p1.{c})" for c in "xyz"] for k in (2, 3)}
    (ax, ay, az), (bx, by, bz) = v[2], v[3]
    normal = (f"{ay} * {bz} - {az} * {by}", f"{az} * {bx} - {ax} * {bz}", f"{ax} * {by} - {ay} * {bx}")
    near = "(CASE WHEN len <> 0 THEN coalesce(abs(a * x + b * y + c * z + d) / len <= {0}, false) ELSE false END OR {1})".format(limit, " OR ".join(f"(x = x{k} AND y = y{k} AND z = z{k} AND intensity IS NOT DISTINCT FROM i{k})" for k in (1, 2, 3)))
    draw_ = lambda k: f"(((it.it * 3 + {k} + it.frame_id * 1000003) % 2147483648) * 2654435761 + 12345) % 2147483648"
    mixed = lambda x: f"((({x} // 65536 * 2 + 1) * ({x} % 65536 * 2 + 1) + {x}) % 2147483648)"
    rank = lambda k: f"((({mixed(f'x{k}')} * 1103515245 + 12345) % 2147483648) // 1024) % it.n"
    sample = ", ".join(f"p{k}.x AS x{k}, p{k}.y AS y{k}, p{k}.z AS z{k}, p{k}.intensity AS i{k}" for k in (1, 2, 3))
    return f"""rk AS (SELECT frame_id, point_idx, x, y, z, intensity, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS rank, count(*) OVER (PARTITION BY frame_id) AS n FROM {cloud}),
 ir AS (SELECT DISTINCT frame_id, n, i.it FROM rk, (SELECT unnest(range({iterations})) AS it) i), it AS (SELECT *, {', '.join(f'{draw_(k)} AS x{k}' for k in (1, 2, 3))} FROM ir it),
 pk AS (SELECT it.frame_id, it.it, p1.point_idx AS s1, p2.point_idx AS s2, p3.point_idx AS s3, {', '.join(f'{e} AS {n}' for e, n in zip(normal, 'abc', strict=True))}, p1.x AS px, p1.y AS py, p1.z AS pz, {sample} FROM it
 {' '.join(f'JOIN rk p{k} ON p{k}.frame_id = it.frame_id AND p{k}.rank = {rank(k)}' for k in (1, 2, 3))}),
 pl AS (SELECT * EXCLUDE (px, py, pz), -(a * px + b * py + c * pz) AS d, sqrt(a * a + b * b + c * c) AS len FROM pk),
 su AS (SELECT pl.frame_id, pl.it, count(*) FILTER (WHERE {near}) AS n FROM pl JOIN {cloud} q ON q.frame_id = pl.frame_id GROUP BY 1, 2),
 bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, it) AS r FROM su) WHERE r = 1),
 sg AS (SELECT q.*, {near} AS is_inlier FROM {cloud} q JOIN pl ON q.frame_id = pl.frame_id JOIN bp ON bp.frame_id = pl.frame_id AND bp.it = pl.it)"""


_PLANE = f"p AS ({b.SMALL_SQL}), {_plane_sql('p', ITERATIONS, LIMIT)}"


@query(f"WITH {_PLANE} SELECT frame_id, CAST(it AS INTEGER) AS it, s1, s2, s3, {_sq(['a', 'b', 'c', 'd', 'len'], 3)} FROM pl")
def plane_candidates(spark, d) -> DataFrame:
    c = plane.candidates(b.small(spark, d), ITERATIONS)
    return c.select("frame_id", "it", "s1", "s2", "s3", *(_q(n, 3).alias(n) for n in ("a", "b", "c", "d", "len")))


@query(f"WITH {_PLANE} SELECT frame_id, CAST(it AS INTEGER) AS it, n FROM su")
def plane_support(spark, d) -> DataFrame:
    p = b.small(spark, d)
    return plane.support(p, plane.candidates(p, ITERATIONS), LIMIT)


@query(f"WITH {_PLANE} SELECT frame_id, point_idx FROM sg WHERE is_inlier")
def ransac_inliers(spark, d) -> DataFrame:
    return plane.segment(b.small(spark, d), ITERATIONS, LIMIT).where("is_inlier").select("frame_id", "point_idx")


@query(f"WITH {_PLANE} SELECT frame_id, point_idx FROM sg WHERE NOT is_inlier")
def ransac_outliers(spark, d) -> DataFrame:
    p = b.small(spark, d)
    return clouds.difference(p, plane.segment(p, ITERATIONS, LIMIT).where("is_inlier"), by="index").select("frame_id", "point_idx")


def _cluster_sql(cloud: str, tol: float, least: int) -> str:
    """CTEs over ``cloud``: clusters (cl) of at least ``least`` points."""
    return f"""ed AS MATERIALIZED (SELECT a.frame_id, a.point_idx AS u, b.point_idx AS v FROM {cloud} a JOIN {cloud} b ON a.frame_id = b.frame_id AND {_DIST} < {tol}),
 rc AS (SELECT frame_id, point_idx AS node, point_idx AS root FROM {cloud} UNION SELECT ed.frame_id, ed.v, rc.root FROM rc JOIN ed ON ed.frame_id = rc.frame_id AND ed.u = rc.node),
 lb AS (SELECT frame_id, node, min(root) AS root FROM rc GROUP BY 1, 2), sz AS (SELECT frame_id, root, count(*) AS n FROM lb GROUP BY 1, 2 HAVING count(*) >= {least}),
 nm AS (SELECT frame_id, root, row_number() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS cluster_id FROM sz),
 cl AS (SELECT nm.frame_id, nm.cluster_id, lb.node AS point_idx FROM nm JOIN lb ON lb.frame_id = nm.frame_id AND lb.root = nm.root)"""


TOL, LEAST = 5.0, 3
_CLUSTERS = f"WITH RECURSIVE p AS ({b.SMALL_SQL}), {_cluster_sql('p', TOL, LEAST)}"


@query(f"{_CLUSTERS} SELECT * FROM cl")
def euclid_clusters(spark, d) -> DataFrame:
    return cluster.clusters(b.small(spark, d), TOL, LEAST).select("frame_id", "cluster_id", "point_idx")


@query(f"{_CLUSTERS} SELECT * FROM cl")
def euclid_components(spark, d) -> DataFrame:
    return cluster.components(b.small(spark, d), TOL, LEAST).select("frame_id", "cluster_id", "point_idx")


@query()
def euclid_clusters_capped(spark, d) -> DataFrame:
    """With a size limit: the growth order decides; tests hold it against a plain queue."""
    return cluster.clusters(b.small(spark, d), TOL, LEAST, 10).select("frame_id", "cluster_id", "point_idx")


@query(f"{_CLUSTERS} SELECT cl.frame_id, cl.cluster_id, count(*) AS n_points, {_EXTENTS} FROM cl JOIN p ON p.frame_id = cl.frame_id AND p.point_idx = cl.point_idx GROUP BY 1, 2")
def cluster_boxes(spark, d) -> DataFrame:
    return clouds.bounding_boxes(cluster.clusters(b.small(spark, d), TOL, LEAST))


PIPE = LidarPipeline((60, 40, 30), ((-20.0, -18.0, -18.0), (20.0, 18.0, 18.0)), ((-1.5, -1.5, -1.5), (1.5, 1.5, 1.5)), 5, 1.0, 7.0, 3, None)
WIDER = LidarPipeline((40, 40, 12), ((-25.0, -20.0, -18.0), (25.0, 20.0, 18.0)), None, 3, 1.5, 9.0, 5, None)


def _pipe_sql(pipe: LidarPipeline) -> str:
    drop = f" AND NOT ({_inside_sql(*pipe.drop)})" if pipe.drop else ""
    return f"""WITH RECURSIVE {_voxel_sql(b.SMALL_SQL, pipe.leaves)}, w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_idx DESC) - 1 AS point_idx FROM v),
 k AS MATERIALIZED (SELECT * FROM w WHERE {_inside_sql(*pipe.keep)}{drop}), {_plane_sql('k', pipe.iterations, pipe.plane_limit)},
 o AS MATERIALIZED (SELECT frame_id, point_idx, x, y, z FROM sg WHERE NOT is_inlier), {_cluster_sql('o', pipe.tol, pipe.least)},
 cb AS (SELECT cl.frame_id, cl.cluster_id, count(*) AS n_points, {_EXTENTS} FROM cl JOIN o ON o.frame_id = cl.frame_id AND o.point_idx = cl.point_idx GROUP BY 1, 2)
 SELECT frame_id, cluster_id, n_points, {_sq(BOX)}, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY cluster_id) - 1 AS INTEGER) AS box_id FROM cb WHERE {_RULE_SQL}"""


def _pipe(spark, d, pipe: LidarPipeline) -> DataFrame:
    r = pipelines.lidar(b.small(spark, d), pipe, _RULE).boxes
    return r.select("frame_id", "cluster_id", "n_points", *(_q(c).alias(c) for c in BOX), "box_id")


@query(_pipe_sql(PIPE))
def lidar_pipeline(spark, d) -> DataFrame:
    """Points to plausible boxes."""
    return _pipe(spark, d, PIPE)


@query(_pipe_sql(WIDER))
def wide_lidar_pipeline(spark, d) -> DataFrame:
    """The preset without an ego crop: coarser cells, a wider crop, a looser plane, farther neighbours."""
    return _pipe(spark, d, WIDER)


# ---------------------------------------------------------------- cameras
_M = rig(calibration(), "left")
_MR = rig(calibration(), "right")


def _project_sql(m, ahead: float = 30.0) -> str:
    row = [" + ".join(f"{float(m[i, j])!r}::DOUBLE * {c}" for j, c in enumerate((f"(x + {ahead})", "y", "z"))) + f" + {float(m[i, 3])!r}::DOUBLE" for i in range(3)]
    return f"pp AS (SELECT frame_id, point_idx, x, y, z, ({row[0]}) / ({row[2]}) AS px, ({row[1]}) / ({row[2]}) AS py, ({row[2]}) AS depth FROM p)"


def _projected(spark, d, m) -> DataFrame:
    """The small cloud 30 m ahead, with pixels."""
    p = b.small(spark, d)
    moved = pipelines.project_points(p.withColumn("x", F.col("x") + 30.0), m)
    return moved.withColumn("x", F.col("x") - 30.0)


@query(f"WITH p AS ({b.SMALL_SQL}), {_project_sql(_M)} SELECT frame_id, point_idx, {_sq(['px', 'py', 'depth'], 3)} FROM pp")
def project_points(spark, d) -> DataFrame:
    return _projected(spark, d, _M).select("frame_id", "point_idx", *(_q(c, 3).alias(c) for c in ("px", "py", "depth")))


@query(f"WITH p AS ({b.SMALL_SQL}), {_project_sql(_MR)} SELECT frame_id, point_idx, {_sq(['px', 'py', 'depth'], 2)} FROM pp")
def project_points_right(spark, d) -> DataFrame:
    return _projected(spark, d, _MR).select("frame_id", "point_idx", *(_q(c, 2).alias(c) for c in ("px", "py", "depth")))


_C = DAHENG_LEFT
_k1, _k2, _p1, _p2, _k3 = (f"({v!r}::DOUBLE)" for v in _C.distortion)


@query(f"""WITH p AS ({b.SMALL_SQL}), n AS (SELECT frame_id, point_idx, y / (x + 40) AS a, z / (x + 40) AS b FROM p), r AS (SELECT *, a * a + b * b AS r2 FROM n), f AS (SELECT *, 1 + {_k1} * r2 + {_k2} * r2 * r2 + {_k3} * r2 * r2 * r2 AS rad FROM r)
 SELECT frame_id, point_idx, {_s(f'{_C.fx!r}::DOUBLE * (a * rad + 2 * {_p1} * a * b + {_p2} * (r2 + 2 * a * a)) + {_C.cx!r}::DOUBLE', 3)} AS px, {_s(f'{_C.fy!r}::DOUBLE * (b * rad + {_p1} * (r2 + 2 * b * b) + 2 * {_p2} * a * b) + {_C.cy!r}::DOUBLE', 3)} AS py FROM f""")
def pinhole_project(spark, d) -> DataFrame:
    u, v = Pinhole(_C).project(F.col("y"), F.col("z"), F.col("x") + 40.0)
    return b.small(spark, d).select("frame_id", "point_idx", _q(u, 3).alias("px"), _q(v, 3).alias("py"))


# ---------------------------------------------------------------- image boxes
_SHRUNK = """sb AS (SELECT *, "left" + CAST(trunc(width * 0.1::DOUBLE / 2) AS INTEGER) AS l, top + CAST(trunc(height * 0.1::DOUBLE / 2) AS INTEGER) AS t, CAST(trunc(width * 0.9::DOUBLE) AS INTEGER) AS w, CAST(trunc(height * 0.9::DOUBLE) AS INTEGER) AS h FROM ib)"""


@query(f'WITH ib AS ({b.BOXES_SQL}), {_SHRUNK} SELECT frame_id, box_id, l AS "left", t AS top, w AS width, h AS height, 900 >= "left" AND 900 < "left" + width AND 700 >= top AND 700 < top + height AS has_point FROM sb')
def box_contains(spark, d) -> DataFrame:
    x = b.image_boxes(spark, d)
    names = ("left", "top", "width", "height")
    return x.select("frame_id", "box_id", *(c.alias(n) for c, n in zip(box.shrunk(0.1), names, strict=True)), box.contains(F.lit(900), F.lit(700)).alias("has_point"))


@query(f"""WITH ib AS ({b.BOXES_SQL}) SELECT frame_id, box_id, c.corner, "left" + c.dx * width AS px, top + c.dy * height AS py FROM ib, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(corner, dx, dy)""")
def roi_corners(spark, d) -> DataFrame:
    return b.image_boxes(spark, d).select("frame_id", "box_id", F.inline(box.roi_points()))


_FUSED = f"""p AS ({b.SMALL_SQL}), {_project_sql(_M)}, ib AS ({b.BOXES_SQL}), {_SHRUNK}, hit AS (SELECT pp.frame_id, pp.point_idx, min(sb.box_id) AS box_id FROM pp JOIN sb ON sb.frame_id = pp.frame_id
 AND trunc(px) >= l AND trunc(px) < l + w AND trunc(py) >= t AND trunc(py) < t + h GROUP BY 1, 2)"""


def _fused(spark, d) -> DataFrame:
    return vision.fuse(_projected(spark, d, _M), b.image_boxes(spark, d))


@query(f"WITH {_FUSED} SELECT * FROM hit")
def fuse_points_boxes(spark, d) -> DataFrame:
    return _fused(spark, d).select("frame_id", "point_idx", "box_id")


@query(f"WITH {_FUSED} SELECT frame_id, box_id, string_agg(CAST(point_idx AS VARCHAR), ',' ORDER BY point_idx) AS point_list FROM hit GROUP BY 1, 2")
def box_point_lists(spark, d) -> DataFrame:
    lists = vision.point_lists(_fused(spark, d))
    return lists.select("frame_id", "box_id", F.array_join(F.transform("lidar_points", lambda p: p["point_idx"].cast("string")), ",").alias("point_list"))


_BEST = f"rd AS ({b.SCORES_SQL}), bc AS (SELECT *, list_max(scores) AS confidence, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS class_id FROM rd)"


@query(f"WITH {_BEST} SELECT row_idx, image_oid, class_id, confidence FROM bc")
def argmax_class(spark, d) -> DataFrame:
    return vision.best_class(b.detections(spark, d)).select("row_idx", "image_oid", "class_id", "confidence")


_BONNET = '630 >= "left" AND 630 < "left" + width AND 660 >= top AND 660 < top + height'


@query(f"WITH {_BEST} SELECT row_idx, image_oid, class_id, confidence, CAST(row_number() OVER (PARTITION BY image_oid ORDER BY confidence DESC, row_idx) - 1 AS INTEGER) AS box_id FROM bc WHERE confidence > 0.9 AND NOT ({_BONNET})")
def confidence_filter(spark, d) -> DataFrame:
    kept = vision.number_boxes(vision.confident(vision.best_class(b.detections(spark, d)), 0.9))
    return kept.select("row_idx", "image_oid", "class_id", "confidence", "box_id")


_IOU = """(greatest(least(k.l + k.w, n."left" + n.width) - greatest(k.l, n."left"), 0) * greatest(least(k.t + k.h, n.top + n.height) - greatest(k.t, n.top), 0))"""


@query(f"""WITH RECURSIVE {_BEST}, n AS (SELECT *, row_number() OVER (PARTITION BY image_oid ORDER BY confidence DESC, row_idx) AS r FROM bc WHERE confidence > 0.4),
 g AS (SELECT image_oid, 0::BIGINT AS r, []::STRUCT(id BIGINT, l INTEGER, t INTEGER, w INTEGER, h INTEGER)[] AS kept FROM n GROUP BY image_oid
 UNION ALL SELECT g.image_oid, n.r, CASE WHEN len(list_filter(g.kept, lambda k: {_IOU} > 0.5 * (k.w * k.h + n.width * n.height - {_IOU}))) = 0
 THEN list_append(g.kept, {{'id': n.row_idx, 'l': n."left", 't': n.top, 'w': n.width, 'h': n.height}}) ELSE g.kept END FROM g JOIN n ON n.image_oid = g.image_oid AND n.r = g.r + 1)
 SELECT image_oid, unnest(kept).id AS row_idx FROM (SELECT image_oid, arg_max(kept, r) AS kept FROM g GROUP BY image_oid)""")
def nms(spark, d) -> DataFrame:
    return vision.suppress(vision.best_class(b.detections(spark, d))).select("image_oid", "row_idx")


@query(f"""WITH ib AS ({b.BOXES_SQL}) SELECT frame_id, box_id, n_name AS class, printf('%d %s %3.2f', box_id, n_name, confidence) AS label, CASE WHEN box_id % 5 = 0 THEN 256 ELSE 128 END AS blue FROM ib LEFT JOIN nation ON n_nationkey = class_id""")
def box_labels(spark, d) -> DataFrame:
    x = vision.with_class_names(b.image_boxes(spark, d), b.class_names(spark, d))
    colour = draw.marker_colour(F.when(F.col("box_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0)), F.lit(1))
    return x.select("frame_id", "box_id", "class", draw.label(F.col("box_id"), F.col("class"), F.col("confidence")).alias("label"), colour[2].alias("blue"))


@query("""SELECT p_partkey AS id, CAST(trunc((p_partkey % 97) / 97.0::DOUBLE * 1920) AS INTEGER) - CAST(trunc(trunc(0.25::DOUBLE * 1920) / 2) AS INTEGER) AS "left",
 CAST(trunc((p_partkey % 89) / 89.0::DOUBLE * 1080) AS INTEGER) - CAST(trunc(trunc(0.2::DOUBLE * 1080) / 2) AS INTEGER) AS top, CAST(trunc(0.25::DOUBLE * 1920) AS INTEGER) AS width, CAST(trunc(0.2::DOUBLE * 1080) AS INTEGER) AS height FROM part""")
def detector_boxes(spark, d) -> DataFrame:
    raw = b.table(spark, d, "part").selectExpr("p_partkey AS id", "(p_partkey % 97) / 97D AS cx", "(p_partkey % 89) / 89D AS cy", "0.25D AS w", "0.2D AS h", "1920 AS img_w", "1080 AS img_h")
    return vision.to_boxes(raw).select("id", "left", "top", "width", "height")


@query(f"""WITH ib AS ({b.BOXES_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS r FROM ib WHERE 1150 >= "left" AND 1150 < "left" + width AND 800 >= top AND 800 < top + height) SELECT frame_id, box_id, "left", top FROM f WHERE r = 1""")
def image_front(spark, d) -> DataFrame:
    return vision.image_front(b.image_boxes(spark, d)).select("frame_id", "box_id", "left", "top")


# ---------------------------------------------------------------- geodesy
_E = geo.WGS84
_ECEF = """f AS ({0}), e AS (SELECT *, {1!r}::DOUBLE / sqrt(1 - {2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS n FROM f),
 xyz AS (SELECT fix_id, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * {3!r}::DOUBLE + alt) * sin(radians(lat)) AS z FROM e)""".format(b.FIXES_SQL, _E.a, _E.e2, 1 - _E.e2)
ORIGIN = (52.5, 13.4, 34.0)


def _origin() -> tuple[str, str]:
    import math

    lat, lon = math.radians(ORIGIN[0]), math.radians(ORIGIN[1])
    n = _E.a / math.sqrt(1 - _E.e2 * math.sin(lat) ** 2)
    o = ((n + ORIGIN[2]) * math.cos(lat) * math.cos(lon), (n + ORIGIN[2]) * math.cos(lat) * math.sin(lon), (n * (1 - _E.e2) + ORIGIN[2]) * math.sin(lat))
    sl, cl, so, co = math.sin(lat), math.cos(lat), math.sin(lon), math.cos(lon)
    delta = ", ".join(f"{c} - ({v!r}::DOUBLE) AS d{c}" for c, v in zip("xyz", o, strict=True))
    east = f"({-so!r}::DOUBLE) * dx + ({co!r}::DOUBLE) * dy"
    north = f"({-sl * co!r}::DOUBLE) * dx + ({-sl * so!r}::DOUBLE) * dy + ({cl!r}::DOUBLE) * dz"
    up = f"({cl * co!r}::DOUBLE) * dx + ({cl * so!r}::DOUBLE) * dy + ({sl!r}::DOUBLE) * dz"
    return delta, f"WITH {_ECEF}, dl AS (SELECT fix_id, {delta} FROM xyz), o AS (SELECT fix_id, {east} AS east, {north} AS north, {up} AS up FROM dl)"


_ENU = _origin()[1]
_LLA = (F.col, ("lat", "lon", "alt"))


def _lla() -> tuple[Column, ...]:
    return tuple(map(F.col, ("lat", "lon", "alt")))


@query(f"WITH {_ECEF} SELECT fix_id, {_sq(['x', 'y', 'z'], 2)} FROM xyz")
def lla_to_ecef(spark, d) -> DataFrame:
    return b.fixes(spark, d).select("fix_id", *(_q(c, 2).alias(n) for c, n in zip(geo.ecef(*_lla()), "xyz", strict=True)))


@query(f"{_ENU} SELECT fix_id, {_sq(['east', 'north', 'up'], 2)} FROM o")
def lla_to_enu(spark, d) -> DataFrame:
    return b.fixes(spark, d).select("fix_id", *(_q(c, 2).alias(n) for c, n in zip(geo.enu(*_lla(), ORIGIN), ("east", "north", "up"), strict=True)))


@query(f"{_ENU}, dn AS (SELECT fix_id, north, east, -up AS down FROM o) SELECT fix_id, {_sq(['north', 'east', 'down'], 2)} FROM dn")
def lla_to_ned(spark, d) -> DataFrame:
    return b.fixes(spark, d).select("fix_id", *(_q(c, 2).alias(n) for c, n in zip(geo.ned(*_lla(), ORIGIN), ("north", "east", "down"), strict=True)))


@query(f"WITH f AS ({b.FIXES_SQL}) SELECT fix_id, {_s('radians(lat)', 6)} AS phi, {_s('radians(lon)', 6)} AS lambda, alt FROM f")
def lla_radians(spark, d) -> DataFrame:
    v = geo.lla_vec(*_lla())
    return b.fixes(spark, d).select("fix_id", _q(v[0], 6).alias("phi"), _q(v[1], 6).alias("lambda"), v[2].alias("alt"))


# ---------------------------------------------------------------- payloads, files, views
@query("""SELECT CAST(label AS BIGINT) AS frame_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS point_idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS intensity FROM embeddings""")
def cloud_decode(spark, d) -> DataFrame:
    """Dimensions packed into payloads with stride 32, and decoded again."""
    p = b.table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("frame_id"), F.col("vec_id").alias("point_idx"), *(F.element_at("embedding", k).alias(n) for k, n in enumerate(("x", "y", "z", "intensity"), 1)))
    return decode_clouds(encode_clouds(p)).select("frame_id", "point_idx", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")))


@query("SELECT event_id AS oid_number, 'WEBP' AS kind, '/data/images/' || event_id || '.webp' AS file_name, 'BGR8' AS encoding FROM events WHERE event_type = 'click'")
def image_file_names(spark, d) -> DataFrame:
    m = b.messages(spark, d).where("kind = 'image'").select("ts_ns", F.col("seq").cast("string").alias("image_oid"), F.lit(1536).alias("height"), F.lit(2048).alias("width"))
    return image_files(m, "/data/images").select(F.col("oid").cast("bigint").alias("oid_number"), "kind", "file_name", "encoding")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) t(pos, name, type)")
def schema_dump(spark, d) -> DataFrame:
    return describe(spark, b.table(spark, d, "region")).drop("nullable")


@query(f"WITH p AS ({b.SMALL_SQL}) SELECT frame_id, point_idx, {_s('y * -5 + 60.0::DOUBLE')} AS px, {_s('x * -5 + 250.0::DOUBLE')} AS py, {_s('(z + 4.75::DOUBLE) * (255 / 7.75::DOUBLE)')} AS c0, {_s('sqrt(x * x + y * y) * 5.1::DOUBLE')} AS c1, {_s('(50.0::DOUBLE - abs(x)) * 5.1::DOUBLE')} AS c2 FROM p")
def topview_coords(spark, d) -> DataFrame:
    x, y, z = map(F.col, "xyz")
    (px, py), colour = draw.top_view(x, y), draw.top_view_colour(x, y, z)
    return b.small(spark, d).select("frame_id", "point_idx", _q(px).alias("px"), _q(py).alias("py"), *(_q(c).alias(f"c{i}") for i, c in enumerate(colour)))


@query("SELECT i AS marker, CAST(500 - i * 50 AS INTEGER) AS y FROM range(10) t(i)")
def range_markers(spark, d) -> DataFrame:
    return draw.range_markers(spark)


@query(f"""WITH p AS ({b.SMALL_SQL}), f AS (SELECT * FROM p WHERE x > 0 AND abs(atan2(y, x)) < radians(45)), e AS (SELECT frame_id, {_EXTENTS} FROM f GROUP BY 1)
 SELECT f.frame_id, point_idx, {', '.join(f'coalesce({_s(f"255.0::DOUBLE * ({c} - xmin) / nullif({c}max - {c}min, 0)")}, 0) AS c{i}' for i, c in enumerate('xyz'))} FROM f JOIN e USING (frame_id)""")
def overlay_colours(spark, d) -> DataFrame:
    dots, _ = pipelines.overlay_list(b.small(spark, d), _small_boxes(spark, d).withColumn("box_id", F.lit(0)), _M)
    return dots.select("frame_id", "point_idx", *(_q(F.col("colour")[i]).alias(f"c{i}") for i in range(3)))


_FRAMES = f"""WITH {_NUMBERED}, ib AS ({b.BOXES_SQL}), fr AS (SELECT DISTINCT frame_id FROM p),
 tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS r FROM nb WHERE xmin > 0 AND xmin < 25 AND {_Y} > -1.5 AND {_Y} < 1.5) WHERE r = 1),
 im AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS r FROM ib WHERE 1150 >= "left" AND 1150 < "left" + width AND 800 >= top AND 800 < top + height) WHERE r = 1)"""


@query(f"""{_FRAMES} SELECT fr.frame_id, (SELECT count(*) FROM nb WHERE nb.frame_id = fr.frame_id) AS n_lidar, tg.box_id AS lidar_target, (SELECT count(*) FROM ib WHERE ib.frame_id = fr.frame_id) AS n_image, im.box_id AS image_target,
 CASE WHEN tg.box_id IS NULL THEN 0 ELSE (SELECT count(*) FROM p WHERE p.frame_id = fr.frame_id AND p.point_idx % 7 = tg.cluster_id) END AS n_target_points FROM fr LEFT JOIN tg ON tg.frame_id = fr.frame_id LEFT JOIN im ON im.frame_id = fr.frame_id""")
def fused_frames(spark, d) -> DataFrame:
    p = b.small(spark, d).withColumn("cluster_id", F.col("point_idx") % 7)
    boxes = lidar_boxes.plausible(_small_boxes(spark, d), _RULE)
    f = pipelines.fused_frames(p.select("frame_id").distinct(), boxes, p, b.image_boxes(spark, d))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("bigint")).otherwise(n(c))
    return f.select("frame_id", count("lidar_bbs").alias("n_lidar"), F.col("target_lidar_bb.box_id").alias("lidar_target"), count("image_bbs").alias("n_image"), F.col("target_image_bb.box_id").alias("image_target"), count("target_lidar_points").alias("n_target_points"))


# ---------------------------------------------------------------- streaming
@query(ORACLES["latest_state_join"])
def stream_latest_state(spark, d) -> DataFrame:
    """The latest-state join of the recorded messages, played as a stream."""
    return live.latest_state(_played(spark, b.messages(spark, d)))


@query(ORACLES["last_two_frames"])
def stream_last_two(spark, d) -> DataFrame:
    """The two-frame history of the fused events, played as a stream."""
    fused = _played(spark, b.messages(spark, d)).where("pc_seq is not null and image_seq is not null")
    return fused.select("run_id", "pos", F.col("pos").alias("newest"), F.col("older_pos").alias("older"))


def _played(spark, messages: DataFrame) -> DataFrame:
    """Messages written as files and merged as a stream to the end of every run."""
    folder = new_folder(spark, "stream")
    m = messages.select("run_id", "kind", "ts_ns", "seq")
    m.write.parquet(f"{folder}/in")
    m.select("run_id").distinct().selectExpr("run_id", f"'{live.END}' AS kind", f"cast({live.END_TS} AS bigint) AS ts_ns", "cast(0 AS bigint) AS seq").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live.run_available(live.merge_stream(live.read_messages(spark, f"{folder}/in", 10_000)), f"{folder}/out", f"{folder}/state")
    out = cut(spark.read.parquet(f"{folder}/out"))
    drop(spark, folder)
    return out


# ---------------------------------------------------------------- files of messages
_STAMP = "struct(struct(cast({sec} AS int) AS sec, cast({nano} AS bigint) AS nanosec) AS stamp, '{frame}' AS frame_id) AS header"


def _cloud_file(spark, d, path: str) -> None:
    """Cloud messages as the recorder writes them: one a label, second by second, a payload of stride 32."""
    p = b.table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("frame_id"), F.col("vec_id").alias("point_idx"), *(F.element_at("embedding", k).alias(n) for k, n in enumerate(("x", "y", "z", "intensity"), 1)))
    rows = encode_clouds(p).selectExpr(
        "0L AS _c0", _STAMP.format(sec="frame_id + 10", nano="frame_id * 100 + 7", frame="lidar"), "height", "width",
        "array(struct('x' AS name, 0L AS offset, 7S AS datatype, 1L AS count)) AS fields", "false AS is_bigendian", "point_step", "point_step * width AS row_step", "data", "true AS is_dense",
    )
    rows.coalesce(1).sortWithinPartitions("header.stamp.sec").write.parquet(path)


def _image_file(spark, d, path: str) -> None:
    """Image messages half a second after each cloud."""
    rows = b.table(spark, d, "embeddings").select("label").distinct().selectExpr(
        "0L AS _c0", _STAMP.format(sec="label + 10", nano="500000000", frame="cam"), "1536L AS height", "2048L AS width", "'bayer' AS encoding", "false AS is_bigendian", "6144L AS step", "concat('oid', label) AS image_oid",
    )
    rows.coalesce(1).sortWithinPartitions("header.stamp.sec").write.parquet(path)


def _scanned(spark, tag: str, write, read) -> DataFrame:
    """What is read back from files written for the purpose."""
    folder = new_folder(spark, tag)
    write(folder)
    out = cut(read(folder))
    drop(spark, folder)
    return out


_PLACED = "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1"


@query(f"SELECT (label::BIGINT + 10) * 1000000000 + label * 100 + 7 AS frame_id, {_PLACED} AS point_idx, {', '.join(f'CAST(embedding[{k}] AS DOUBLE) AS {n}' for k, n in enumerate(('x', 'y', 'z', 'intensity'), 1))} FROM embeddings")
def scan_point_clouds(spark, d) -> DataFrame:
    """Cloud messages written to a file, scanned by position and decoded."""
    got = _scanned(spark, "clouds", lambda f: _cloud_file(spark, d, f), lambda f: scan_clouds(spark, f))
    return got.select("frame_id", "point_idx", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")))


@query("SELECT (label::BIGINT + 10) * 1000000000 + label * 100 + 7 AS ts_ns, label + 10 AS stamp_sec, 'lidar' AS frame, 1 AS height, count(*) AS width, 32 AS point_step, 'x' AS first_field, 32 * count(*) AS bytes FROM embeddings GROUP BY label")
def scan_cloud_headers(spark, d) -> DataFrame:
    got = _scanned(spark, "headers", lambda f: _cloud_file(spark, d, f), lambda f: decode(scan(spark, f, "point_cloud2"), "point_cloud2"))
    return got.select("ts_ns", "stamp_sec", "frame", "height", "width", "point_step", F.col("fields")[0]["name"].alias("first_field"), F.octet_length("data").alias("bytes"))


@query("SELECT DISTINCT (label::BIGINT + 10) * 1000000000 + 500000000 AS ts_ns, 'cam' AS frame, 1536 AS height, 2048 AS width, 'bayer' AS encoding, false AS is_bigendian, 6144 AS step, 'oid' || label AS image_oid FROM embeddings")
def scan_images(spark, d) -> DataFrame:
    got = _scanned(spark, "images", lambda f: _image_file(spark, d, f), lambda f: decode(scan(spark, f, "image"), "image"))
    return got.select("ts_ns", "frame", "height", "width", "encoding", "is_bigendian", "step", "image_oid")


@query(f"WITH f AS ({b.FIXES_SQL}) SELECT fix_id * 1000000000 + 5 AS ts_ns, 1 AS status, 2 AS service, lat AS latitude, lon AS longitude, alt AS altitude, 9 AS n_covariance, CAST(fix_id % 10 * (fix_id % 10 + 1) / 2 AS DOUBLE) AS covariance_sum, 3 AS position_covariance_type FROM f")
def scan_nav_sat_fixes(spark, d) -> DataFrame:
    """Fixes whose covariances have none to nine values; missing ones are 0."""

    def write(f):
        b.fixes(spark, d).selectExpr(
            "0L AS _c0", _STAMP.format(sec="fix_id", nano="5", frame="gps"), "struct(1Y AS status, 2 AS service) AS status", "lat AS latitude", "lon AS longitude", "alt AS altitude",
            "if(fix_id % 10 = 0, cast(array() AS array<double>), transform(sequence(1, cast(fix_id % 10 AS int)), x -> cast(x AS double))) AS position_covariance", "3S AS position_covariance_type",
        ).write.parquet(f)

    got = _scanned(spark, "fixes", write, lambda f: decode(scan(spark, f, "nav_sat_fix"), "nav_sat_fix"))
    return got.select("ts_ns", "status.status", "status.service", "latitude", "longitude", "altitude", F.size("position_covariance").alias("n_covariance"), F.aggregate("position_covariance", F.lit(0.0), lambda a, x: a + x).alias("covariance_sum"), "position_covariance_type")


_WHEELS = ("vs_eng", "wheel_fl", "wheel_fr", "wheel_rl", "wheel_rr", "long_accel", "lat_accel", "yaw_rate", "sas_angle", "sas_speed", "dt_sec", "sas_radians", "vs", "v_mps")


@query(f"SELECT c_custkey * 1000000000 + 9 AS ts_ns, (c_custkey + 1) * 1000000000 + 11 AS timeref_ns, {', '.join(f'CAST((c_custkey * {k + 3}) % 1024 / 8.0 AS DOUBLE) AS {n}' for k, n in enumerate(_WHEELS))} FROM customer")
def scan_vehicle_states(spark, d) -> DataFrame:
    def write(f):
        b.table(spark, d, "customer").selectExpr(
            "0L AS _c0", _STAMP.format(sec="c_custkey", nano="9", frame="car"), "struct(cast(c_custkey + 1 AS int) AS sec, 11L AS nanosec) AS timeref", *(f"cast((c_custkey * {k + 3}) % 1024 / 8 AS float) AS {n}" for k, n in enumerate(_WHEELS)),
        ).write.parquet(f)

    got = _scanned(spark, "states", write, lambda f: decode(scan(spark, f, "vehicle_state"), "vehicle_state"))
    return got.select("ts_ns", "timeref_ns", *(F.col(n).cast("double").alias(n) for n in _WHEELS))


@query(f"""WITH m AS (SELECT DISTINCT label, (label::BIGINT + 10) * 1000000000 + label * 100 + 7 AS ts_ns, 'pc' AS kind FROM embeddings UNION ALL SELECT DISTINCT label, (label::BIGINT + 10) * 1000000000 + 500000000, 'image' FROM embeddings),
 n AS (SELECT *, row_number() OVER (ORDER BY ts_ns) - 2 AS pos FROM m), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
 SELECT pos, ts_ns, kind, CASE WHEN kind = 'image' THEN '/data/run/oid' || label || '.webp' END AS file_name, CASE WHEN kind = 'pc' THEN c.n END AS n_points FROM n JOIN c USING (label) WHERE pos >= 0 AND ts_ns < 17700000000""")
def scan_merged_run(spark, d) -> DataFrame:
    """Clouds and images of a run, interleaved from their files; a fix at 17.7 seconds ends it."""

    def write(f):
        _cloud_file(spark, d, f"{f}/pc")
        _image_file(spark, d, f"{f}/image")

    def read(f):
        fix = spark.range(1).selectExpr("'fix' AS kind", "17700000000L AS ts_ns", "0L AS seq")
        m = cut(scan_merged(spark, f"{f}/pc", f"{f}/image", "/data/run", fix))
        n = points_of(m).groupBy(F.col("frame_id").alias("pos")).agg(F.count("*").alias("n_points"))
        return m.join(n, "pos", "left").select("pos", "ts_ns", "kind", "file_name", "n_points")

    return _scanned(spark, "run", write, read)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS oid, CASE WHEN n_nationkey < 20 THEN md5(n_name) END AS digest, CASE WHEN n_nationkey < 20 THEN length(n_name) END AS bytes FROM nation")
def image_contents(spark, d) -> DataFrame:
    """Image rows with the content of their files; a few have none."""
    nations = b.table(spark, d, "nation").select("n_nationkey", "n_name")

    def write(f):
        for r in nations.where("n_nationkey < 20").collect():  # twenty small files
            put_bytes(spark, f"{f}/{r['n_nationkey']}.webp", r["n_name"].encode())

    got = _scanned(spark, "contents", write, lambda f: with_bytes(spark, nations.select(F.col("n_nationkey").cast("string").alias("oid")), f))
    return got.select("oid", F.md5("content").alias("digest"), F.octet_length("content").alias("bytes"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS class_id, n_name AS class FROM nation")
def class_file(spark, d) -> DataFrame:
    """A file with one class name a line."""
    names = [r["n_name"] for r in b.table(spark, d, "nation").orderBy("n_nationkey").collect()]  # the classes of a detector
    return _scanned(spark, "classes", lambda f: put_bytes(spark, f"{f}/names", ("\n".join(names) + "\n").encode()), lambda f: class_names(spark, f"{f}/names"))


_SHIFT = 3


@query(f"""WITH i AS (SELECT n_nationkey AS oid, v, u, CASE WHEN u >= {_SHIFT} THEN (n_nationkey * 7 + v * 8 + u - {_SHIFT}) % 251 ELSE 0 END AS pixel FROM nation, range(6) r(v), range(8) s(u))
 SELECT CAST(oid AS VARCHAR) AS oid, CAST(sum(pixel) AS BIGINT) AS total, CAST(sum(pixel * (v * 8 + u)) AS BIGINT) AS weighted FROM i GROUP BY oid""")
def rectified_images(spark, d) -> DataFrame:
    """Images remapped in the tasks; the new principal point moves every pixel to the right."""
    pixels = f"array_join(transform(sequence(0, 47), i -> lpad(hex((n_nationkey * 7 + i) % 251), 2, '0')), '')"  # noqa: F541
    images = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("oid"), F.unhex(F.expr(pixels)).alias("content"))
    k = np.array([[10.0, 0.0, 4.0], [0.0, 10.0, 3.0], [0.0, 0.0, 1.0]])
    new_k = k + np.array([[0.0, 0.0, _SHIFT], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    got = pipelines.rectify(images, k, np.zeros(5), np.eye(3), new_k, (8, 6), lambda c: np.frombuffer(c, np.uint8).reshape(6, 8), lambda x: x.tobytes())
    values = F.expr("transform(sequence(1, 48), i -> cast(conv(hex(substring(content, i, 1)), 16, 10) AS bigint))")
    return got.select("oid", F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.expr("aggregate(transform(sequence(1, 48), i -> cast(conv(hex(substring(content, i, 1)), 16, 10) AS bigint) * (i - 1)), 0L, (a, x) -> a + x)").alias("weighted"))


def _matrix_rows():
    held = {n: m for n, m in calibration().matrices.items()}
    return held | {n: np.arange(9.0).reshape(3, 3) + i for i, n in enumerate(NAMES) if n not in held}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {m.shape[0]}, {m.shape[1]}, {float(m[0, 0])!r}::DOUBLE, {float(m[-1, -1])!r}::DOUBLE)" for n, m in _matrix_rows().items()) + ") t(name, rows, cols, first, last)")
def calibration_file(spark, d) -> DataFrame:
    """A calibration file as the stereo rig's software writes it, read back."""
    one = lambda n, m: f"{n}: !!opencv-matrix\n   rows: {m.shape[0]}\n   cols: {m.shape[1]}\n   dt: d\n   data: [ {', '.join(repr(float(v)) for v in m.ravel())} ]\n"
    text = "%YAML:1.0\n---\n" + "".join(one(n, m) for n, m in _matrix_rows().items())
    got = _scanned(spark, "calibration", lambda f: put_bytes(spark, f"{f}/stereo.yaml", text.encode()), lambda f: StereoCalibration.read(spark, f"{f}/stereo.yaml").rows(spark))
    return got.select("name", "rows", "cols", F.col("data")[0].alias("first"), F.element_at("data", -1).alias("last"))


@query(f"WITH p AS ({b.LARGE_SQL}) SELECT frame_id, count(DISTINCT (trunc(x * 1000), trunc(y * 1000), trunc(z * 1000), trunc(intensity * 10))) AS n_keys FROM p GROUP BY frame_id")
def point_hash_keys(spark, d) -> DataFrame:
    return b.large(spark, d).groupBy("frame_id").agg(F.countDistinct(points.hash_key()).alias("n_keys"))


@query("SELECT * FROM (VALUES ('image', '/data/parquet/image_7.parquet'), ('images', '/data/images_7/'), ('point_cloud2', '/data/parquet/point_cloud2_7.parquet'), ('rectified', '/data/rectified_7')) t(name, path)")
def run_files(spark, d) -> DataFrame:
    return spark.createDataFrame(sorted(run_paths("/data", "7").items()), "name string, path string")


@query(f"WITH {_BOXES}, nb AS (SELECT *, 0 AS box_id FROM bb) SELECT frame_id, count(*) AS n_lines, {', '.join(f'{_s(f"sum({e})", 2)} AS {n}' for n, e in (('a', 'ax'), ('b', 'az'), ('c', 'bz')))} FROM ({_wireframe_sql()}) GROUP BY frame_id")
def overlay_edges(spark, d) -> DataFrame:
    """Box edges drawn over the image."""
    _, lines = pipelines.overlay_list(b.small(spark, d), _small_boxes(spark, d).withColumn("box_id", F.lit(0)), _M)
    return lines.groupBy("frame_id").agg(F.count("*").alias("n_lines"), *(_q(F.sum(e), 2).alias(n) for n, e in (("a", "ax"), ("b", "az"), ("c", "bz"))))


_TOP = lambda x, y: (f"CAST(trunc(y{y} * -5 + 60.0::DOUBLE) AS INTEGER)", f"CAST(trunc(x{x} * -5 + 250.0::DOUBLE) AS INTEGER)")


@query(f"WITH {_NUMBERED} SELECT frame_id, box_id, {_TOP('min', 'min')[0]} AS ax, {_TOP('min', 'min')[1]} AS ay, {_TOP('max', 'max')[0]} AS bx, {_TOP('max', 'max')[1]} AS by, CAST(box_id AS VARCHAR) AS label, CASE WHEN xmin > 0 AND xmin < 25 AND {_Y} > -1.5 AND {_Y} < 1.5 THEN 128 ELSE 255 END AS blue FROM nb")
def topview_boxes(spark, d) -> DataFrame:
    """Boxes drawn from above; one ahead of the ego vehicle has the target's colour."""
    p = b.small(spark, d)
    _, rects = pipelines.top_view_list(p, lidar_boxes.plausible(_small_boxes(spark, d), _RULE))
    return rects.select("frame_id", "box_id", "ax", "ay", "bx", "by", "label", F.col("colour")[0].alias("blue"))


@query(f"""WITH {_NUMBERED}, pt AS ({b.SMALL_SQL}), r AS (SELECT frame_id, {_TOP('min', 'min')[0]} AS ax, {_TOP('min', 'min')[1]} AS ay, {_TOP('max', 'max')[0]} AS bx, {_TOP('max', 'max')[1]} AS by FROM nb),
px AS (SELECT frame_id, CAST(trunc(y * -5 + 60.0::DOUBLE) AS BIGINT) AS px, CAST(trunc(x * -5 + 250.0::DOUBLE) AS BIGINT) AS py FROM pt
 UNION SELECT frame_id, unnest(range(least(ax, bx), greatest(ax, bx) + 1)), ay FROM r UNION SELECT frame_id, unnest(range(least(ax, bx), greatest(ax, bx) + 1)), r.by FROM r
 UNION SELECT frame_id, ax, unnest(range(least(ay, r.by), greatest(ay, r.by) + 1)) FROM r UNION SELECT frame_id, bx, unnest(range(least(ay, r.by), greatest(ay, r.by) + 1)) FROM r)
SELECT frame_id, count(*) AS n_drawn, 180000 AS n_bytes FROM px WHERE px BETWEEN 0 AND 119 AND py BETWEEN 0 AND 499 GROUP BY frame_id""")
def topview_raster(spark, d) -> DataFrame:
    """The view from above as pixels: 120 by 500, points and boxes."""
    p = b.small(spark, d)
    dots, rects = pipelines.top_view_list(p, lidar_boxes.plausible(_small_boxes(spark, d), _RULE))
    width, height = draw.WORLD_WIDTH * draw.PIXELS, draw.WORLD_LENGTH * draw.PIXELS
    return raster.render(dots, raster.edges_of(rects), width, height).select("frame_id", "n_drawn", F.length("content").alias("n_bytes"))


_HIGH = lambda k: f"CAST(round(CAST({k} AS FLOAT) * CAST(h AS FLOAT)) AS INTEGER)"


@query(f"""WITH ib AS (SELECT box_id, "left", top, CAST(5 + box_id % 60 AS INTEGER) AS w, CAST(8 + box_id % 13 AS INTEGER) AS h FROM ({b.BOXES_SQL}))
SELECT box_id, "left", greatest(top, h) - {_HIGH(1.25)} AS top, CAST(round(CAST(1.05 AS FLOAT) * CAST(w AS FLOAT)) AS INTEGER) AS width, 4 + {_HIGH(1.25)} AS height, greatest(top, h) - {_HIGH(1.5)} AS seen_from_above FROM ib""")
def label_boxes(spark, d) -> DataFrame:
    """Rectangles behind labels, for texts of given sizes."""
    left, top, w, h = F.col("left"), F.col("top"), (F.lit(5) + F.col("box_id") % 60).cast("int"), (F.lit(8) + F.col("box_id") % 13).cast("int")
    at = draw.label_box(left, top, w, h, F.lit(4))
    above = draw.label_box(left, top, w, h, F.lit(4), 1.5, 1.5)
    return b.image_boxes(spark, d).select("box_id", *(c.alias(n) for c, n in zip(at, ("left", "top", "width", "height"), strict=True)), above[1].alias("seen_from_above"))


@query(f"WITH {_merge_sql(b.EXACT_TS)}, {_STATE} SELECT run_id, pos, pc_seq, image_seq, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS frame_seq, (row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1) * 20000000 AS show_ns FROM fu")
def video_frames(spark, d) -> DataFrame:
    """The frames of a video of 50 a second, one a fused event."""
    return merge.video_frames(latest_state_join(spark, d)).select("run_id", "pos", "pc_seq", "image_seq", "frame_seq", "show_ns")


def _toy_detector():
    """A stand-in for a network: one box an image, sized by the number of bytes."""

    def model(content: bytes) -> np.ndarray:
        n = len(content)
        return np.array([[0.5, 0.5, n / 128, n / 64, 1.0, n % 8 / 8, n % 4 / 4]])

    return model


@query("""WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS image_oid, CAST(length(n_name) + n_nationkey AS INTEGER) AS n FROM nation), c AS (SELECT *, greatest(n % 8 / 8.0::DOUBLE, n % 4 / 4.0::DOUBLE) AS confidence FROM n)
 SELECT image_oid, 0 AS box_id, CASE WHEN n % 8 / 8.0::DOUBLE >= n % 4 / 4.0::DOUBLE THEN 0 ELSE 1 END AS class_id, confidence, 512 - 4 * n AS "left", 512 - 8 * n AS top, 8 * n AS width, 16 * n AS height FROM c WHERE confidence > 0.4 AND NOT (4 * n > 118 AND 8 * n > 148)""")
def detector_chain(spark, d) -> DataFrame:
    """Images to numbered boxes: detector in the tasks, best class, threshold, boxes, suppression, bonnet."""
    images = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("image_oid"), F.expr("encode(concat(n_name, repeat('x', n_nationkey)), 'utf-8')").alias("content"), F.lit(1024).alias("img_w"), F.lit(1024).alias("img_h"))
    got = vision.detect(images, _toy_detector, 2)
    return got.select("image_oid", "box_id", "class_id", F.col("confidence").cast("double").alias("confidence"), "left", "top", "width", "height")
