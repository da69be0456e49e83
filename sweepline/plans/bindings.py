"""The test tables read as recordings: each binding as a DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SQL = """SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_idx, CAST(embedding[1] AS DOUBLE) * 50 AS x,
 CAST(embedding[2] AS DOUBLE) * 50 AS y, CAST(embedding[3] AS DOUBLE) * 50 AS z, CAST(embedding[4] AS DOUBLE) * 50 AS intensity FROM embeddings"""

LARGE_SQL = """SELECT l_returnflag AS frame_id, ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS point_idx,
 l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax AS intensity FROM lineitem"""

MESSAGES_SQL = """SELECT user_id % 8 AS run_id, CASE event_type WHEN 'view' THEN 'pc' ELSE 'image' END AS kind, {ts} AS ts_ns, event_id AS seq
 FROM events WHERE event_type IN ('view', 'click')"""
EXACT_TS, DAY_TS = "epoch_us(ts) * 1000", "epoch_us(date_trunc('day', ts)) * 1000"

BOXES_SQL = """SELECT p_partkey % 10 AS frame_id, CAST(p_partkey AS INTEGER) AS box_id, CAST((p_partkey * 37) % 1800 AS INTEGER) AS "left",
 CAST((p_partkey * 53) % 1300 AS INTEGER) AS top, CAST(60 + p_partkey % 200 AS INTEGER) AS width, CAST(60 + p_partkey % 150 AS INTEGER) AS height,
 (p_partkey % 100) / 100.0::DOUBLE AS confidence, CAST(p_partkey % 25 AS INTEGER) AS class_id FROM part"""

FIXES_SQL = """SELECT c_custkey AS fix_id, CAST(c_custkey % 181 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 361 - 180 AS DOUBLE) AS lon, c_acctbal AS alt FROM customer"""

SCORES_SQL = """SELECT p_partkey AS row_idx, p_partkey % 50 AS image_oid, list_transform(range(5), lambda k: ((p_partkey * (k + 3) * 17) % 101) / 100.0::DOUBLE) AS scores,
 CAST((p_partkey * 37) % 1800 AS INTEGER) AS "left", CAST((p_partkey * 53) % 1300 AS INTEGER) AS top, CAST(160 + p_partkey % 400 AS INTEGER) AS width,
 CAST(160 + p_partkey % 350 AS INTEGER) AS height FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ten frames from embeddings."""
    e = [F.element_at("embedding", k).cast("double") * 50 for k in (1, 2, 3, 4)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("frame_id"), F.col("vec_id").alias("point_idx"), *(c.alias(n) for c, n in zip(e, ("x", "y", "z", "intensity"), strict=True)))


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of three frames from lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS frame_id", "((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS point_idx",
        "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z", "l_tax AS intensity",
    )


def messages(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """Clouds (views) and images (clicks) of eight runs from events; by day, most timestamps are equal."""
    ts = "date_trunc('day', ts)" if by_day else "ts"
    return table(spark, sf_dir, "events").where("event_type in ('view', 'click')").selectExpr(
        "user_id % 8 AS run_id", "if(event_type = 'view', 'pc', 'image') AS kind",
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} AS timestamp_ntz)) * 1000 AS ts_ns", "event_id AS seq",
    )


def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 10 AS frame_id", "cast(p_partkey AS int) AS box_id", "cast((p_partkey * 37) % 1800 AS int) AS left", "cast((p_partkey * 53) % 1300 AS int) AS top",
        "cast(60 + p_partkey % 200 AS int) AS width", "cast(60 + p_partkey % 150 AS int) AS height", "(p_partkey % 100) / 100D AS confidence", "cast(p_partkey % 25 AS int) AS class_id",
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS fix_id", "cast(c_custkey % 181 - 90 AS double) AS lat", "cast((c_custkey * 7) % 361 - 180 AS double) AS lon", "c_acctbal AS alt")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with five scores each, 50 images."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_idx", "p_partkey % 50 AS image_oid", "transform(sequence(0, 4), k -> ((p_partkey * (k + 3) * 17) % 101) / 100D) AS scores",
        "cast((p_partkey * 37) % 1800 AS int) AS left", "cast((p_partkey * 53) % 1300 AS int) AS top", "cast(160 + p_partkey % 400 AS int) AS width", "cast(160 + p_partkey % 350 AS int) AS height",
    )


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class"))
