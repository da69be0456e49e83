"""Schemas of the recorded messages; unsigned integers take the next wider Spark type."""

from __future__ import annotations

from pyspark.sql import types as T

_STAMP = "struct<sec:int,nanosec:bigint>"
HEADER = f"struct<stamp:{_STAMP},frame_id:string>"

#: name -> DDL of the columns after the leading one, which is never read
MESSAGES = {
    "image": f"header {HEADER}, height bigint, width bigint, encoding string, is_bigendian boolean, step bigint, image_oid string",
    "point_cloud2": (
        f"header {HEADER}, height bigint, width bigint, fields array<struct<name:string,offset:bigint,datatype:smallint,count:bigint>>, "
        "is_bigendian boolean, point_step bigint, row_step bigint, data binary, is_dense boolean"
    ),
    "nav_sat_fix": (
        f"header {HEADER}, status struct<status:tinyint,service:int>, latitude double, longitude double, altitude double, "
        "position_covariance array<double>, position_covariance_type smallint"
    ),
    "vehicle_state": (
        f"header {HEADER}, timeref {_STAMP}, "
        + ", ".join(f"{c} float" for c in ("vs_eng", "wheel_fl", "wheel_fr", "wheel_rl", "wheel_rr", "long_accel", "lat_accel", "yaw_rate", "sas_angle", "sas_speed", "dt_sec", "sas_radians", "vs", "v_mps"))
    ),
}


def schema(kind: str) -> T.StructType:
    """StructType of a message kind: ``image``, ``point_cloud2``, ``nav_sat_fix`` or ``vehicle_state``."""
    return T._parse_datatype_string(MESSAGES[kind])


POINTS = "frame_id bigint, point_idx bigint, x float, y float, z float, intensity float"

IMAGE_BOXES = "frame_id bigint, box_id int, left int, top int, width int, height int, class_id int, class string, confidence float"
LIDAR_BOXES = "frame_id bigint, box_id int, cluster_id int, track_id int, xmin float, ymin float, zmin float, xmax float, ymax float, zmax float"
IMAGE_FRAME_MATCHES = "map<int,int>"
