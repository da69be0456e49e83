"""Plane segmentation by sampled triples (RANSAC) with a fixed rule for the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COORDS = ("x", "y", "z")
# The sample rule's numbers; whole-number arithmetic that any engine has.
MODULUS, FIRST, SECOND, PLUS, SPREAD, HALF, KEPT = 2_147_483_648, 2_654_435_761, 1_103_515_245, 12_345, 1_000_003, 65_536, 1_024


def _rank(it, k, seed, n):
    """Two rounds of a congruential generator with a product of the halves between them, else all samples keep their distance."""
    x = F.pmod((it.cast("bigint") * 3 + F.lit(k) + seed.cast("bigint") * SPREAD) % MODULUS * F.lit(FIRST) + PLUS, F.lit(MODULUS))
    high, low = F.floor(x / F.lit(HALF)).cast("bigint"), x % HALF
    x = ((high * 2 + 1) * (low * 2 + 1) + x) % MODULUS
    x = (x * F.lit(SECOND) + PLUS) % MODULUS
    return F.pmod(F.floor(x / F.lit(KEPT)).cast("bigint"), n)


def candidates(points: DataFrame, iterations: int) -> DataFrame:
    """(frame_id, it, s1, s2, s3, a, b, c, d, len, q1, q2, q3): a plane through three points of the frame per iteration.

    The rank of the k-th sample of iteration i comes from a fixed generator seeded with both and the frame (``_rank``).
    Samples may coincide: then the normal has length 0. q1 to q3 are the samples' values.
    """
    values = _values(points)
    ranked = points.select("frame_id", "point_idx", *values, (F.row_number().over(Window.partitionBy("frame_id").orderBy("point_idx")) - 1).alias("_rank"))
    n = points.groupBy("frame_id").agg(F.count("*").alias("_n"))
    its = n.select("frame_id", "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")) if iterations > 0 else n.select("frame_id", "_n", F.lit(0).alias("it")).where("false")
    seed = F.abs(F.hash("frame_id")) if dict(points.dtypes)["frame_id"] == "string" else F.col("frame_id")
    picks = its.select("frame_id", "it", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _rank(F.col("it"), k, seed, F.col("_n")).alias("_rank")) for k in (1, 2, 3)))).alias("p"))
    found = picks.select("frame_id", "it", "p.k", "p._rank").join(ranked, ["frame_id", "_rank"])
    one = found.groupBy("frame_id", "it").agg(*(F.max(F.when(F.col("k") == k, F.struct("point_idx", *values))).alias(f"p{k}") for k in (1, 2, 3)))

    def v(k):
        return [F.col(f"p{k}.{c}").cast("double") - F.col(f"p1.{c}") for c in COORDS]

    (ax, ay, az), (bx, by, bz) = v(2), v(3)
    normal = [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]
    one = one.select("frame_id", "it", *(F.col(f"p{k}.point_idx").alias(f"s{k}") for k in (1, 2, 3)), *(c.alias(n) for c, n in zip(normal, "abc", strict=True)), *(F.col(f"p1.{c}").cast("double").alias(f"_{c}") for c in COORDS), *(F.struct(*(F.col(f"p{k}.{c}") for c in values)).alias(f"q{k}") for k in (1, 2, 3)))
    d = -(F.col("a") * F.col("_x") + F.col("b") * F.col("_y") + F.col("c") * F.col("_z"))
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return one.withColumns({"d": d, "len": size}).drop("_x", "_y", "_z")


def _on_plane(limit: float, values: list[str]):
    far = F.abs(F.col("p.a") * F.col("x") + F.col("p.b") * F.col("y") + F.col("p.c") * F.col("z") + F.col("p.d"))
    near = F.coalesce(F.try_divide(far, F.col("p.len")) <= F.lit(limit), F.lit(False))
    is_sample = F.lit(False)
    for q in ("p.q1", "p.q2", "p.q3"):  # a point with a sample's values counts like the sample
        same = F.lit(True)
        for c in values:
            same = same & F.col(f"{q}.{c}").eqNullSafe(F.col(c))
        is_sample = is_sample | same
    return near | is_sample


def _values(points: DataFrame) -> list[str]:
    return [*COORDS, *(["intensity"] if "intensity" in points.columns else [])]


def _with_planes(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Points joined with the planes of their frame, held in one array: no point is shuffled per iteration."""
    held = planes.groupBy("frame_id").agg(F.collect_list(F.struct(*[c for c in planes.columns if c != "frame_id"])).alias("_planes"))
    return points.join(held, "frame_id").withColumn("p", F.explode("_planes")).drop("_planes")


def support(points: DataFrame, planes: DataFrame, limit: float) -> DataFrame:
    """(frame_id, it, n): points within ``limit`` of each plane, or among its samples."""
    return _with_planes(points, planes).groupBy("frame_id", F.col("p.it").alias("it")).agg(F.count_if(_on_plane(limit, _values(points))).alias("n"))


def best(points: DataFrame, iterations: int, limit: float) -> DataFrame:
    """The plane with most support in each frame; the first of equal ones."""
    planes = candidates(points, iterations)
    counted = support(points, planes, limit)
    top = counted.groupBy("frame_id").agg(F.max_by(F.col("it"), F.struct(F.col("n"), -F.col("it"))).alias("it"), F.max("n").alias("n"))
    return planes.join(top, ["frame_id", "it"])


def segment(points: DataFrame, iterations: int, limit: float) -> DataFrame:
    """Points with ``is_inlier``: on the best plane of their frame. Without iterations nothing is on it."""
    if iterations < 1:
        return points.withColumn("is_inlier", F.lit(False))
    plane = best(points, iterations, limit).select("frame_id", F.struct("q1", "q2", "q3", "a", "b", "c", "d", "len").alias("p"))
    return points.join(plane, "frame_id").withColumn("is_inlier", _on_plane(limit, _values(points))).drop("p")
