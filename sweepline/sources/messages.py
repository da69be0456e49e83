"""Scans of recorded messages, their flat projections, and small side files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import MESSAGES, schema

FIELDS = {
    "image": ["height", "width", "encoding", "is_bigendian", "step", "image_oid"],
    "point_cloud2": ["height", "width", "fields", "is_bigendian", "point_step", "row_step", "data", "is_dense"],
    "nav_sat_fix": ["status", "latitude", "longitude", "altitude", "position_covariance_type"],
    "vehicle_state": [c.split()[0] for c in MESSAGES["vehicle_state"].split(", ")[2:]],
}


def ts_ns(sec, nanosec):
    """Nanoseconds since the epoch: the ordering key (timestamps hold microseconds only)."""
    return sec.cast("bigint") * F.lit(1_000_000_000) + nanosec.cast("bigint")


def event_time(ns):
    """Timestamp of an ordering key, for display and watermarks."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000)).cast("bigint"))


def scan(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """Parquet files of messages with ``_path``; with ``kind``, columns are taken by position as the recorder wrote them.

    Only what a later projection needs is read: the payload column stays on disk for header queries.
    """
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    if kind:
        want = schema(kind)
        have = df.columns[-len(want) :] if len(df.columns) > len(want) else df.columns
        if len(have) != len(want):
            raise ValueError(f"{kind} has {len(want)} columns after the first; the files have {len(df.columns)}")
        df = df.select(*(F.col(f"`{h}`").cast(f.dataType).alias(f.name) for h, f in zip(have, want, strict=True)), F.col("_metadata.file_path").alias("_path"))
        return df
    return df.select("*", F.col("_metadata.file_path").alias("_path"))


def _header(df: DataFrame) -> list:
    stamp = F.col("header.stamp")
    ns = ts_ns(stamp["sec"], stamp["nanosec"])
    return [ns.alias("ts_ns"), event_time(ns).alias("event_time"), stamp["sec"].alias("stamp_sec"), stamp["nanosec"].alias("stamp_nanosec"), F.col("header.frame_id").alias("frame")]


def decode(df: DataFrame, kind: str) -> DataFrame:
    """Flat columns of a message: header fields, then the kind's own."""
    extra = []
    if kind == "nav_sat_fix":
        cov = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.coalesce(F.get("position_covariance", i), F.lit(0.0)))
        checked = F.when(F.coalesce(F.size("position_covariance"), F.lit(0)) > 9, F.raise_error(F.lit("a covariance has at most 9 values"))).otherwise(cov)
        extra = [checked.cast("array<double>").alias("position_covariance")]
    if kind == "vehicle_state":
        ns = ts_ns(F.col("timeref.sec"), F.col("timeref.nanosec"))
        extra = [ns.alias("timeref_ns"), event_time(ns).alias("timeref")]
    return df.select(*_header(df), *FIELDS[kind], *extra)


def image_files(images: DataFrame, path: str | None = None) -> DataFrame:
    """Image messages as files: kind and encoding are fixed, the name is ``path/oid.webp`` or empty without a path."""
    name = F.concat(F.lit(path), F.lit("/"), F.col("image_oid"), F.lit(".webp")) if path is not None else F.lit(None).cast("string")
    return images.select(
        "ts_ns", F.lit("WEBP").alias("kind"), F.lit(path).cast("string").alias("path"), F.col("image_oid").alias("oid"),
        F.coalesce(name, F.lit("")).alias("file_name"), "height", "width", F.lit("BGR8").alias("encoding"),
    )


def describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(pos, name, type, nullable): the schema as rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "pos int, name string, type string, nullable boolean")


def first_row(df: DataFrame, by: list[str]) -> DataFrame:
    """(pos, name, value) of the first row in the given order; binary values are elided."""
    one = df.orderBy(*by).limit(1)
    items = [
        F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("name"), (F.lit("binary") if f.dataType.simpleString() == "binary" else F.col(f"`{f.name}`").cast("string")).alias("value"))
        for i, f in enumerate(df.schema)
    ]
    return one.select(F.inline(F.array(*items)))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class) of a file with one name a line; a few hundred lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("class_id", "class"))
    return lines


def with_bytes(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Image rows joined with the content of ``folder/oid.webp``; rows without a file are kept."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.webp").load(folder)
    named = raw.select(F.regexp_extract("path", r"([^/]+)\.webp$", 1).alias("oid"), "content")
    return files.join(named, "oid", "left")


def prepare_folder(spark: SparkSession, path: str) -> None:
    """Create an output folder on any Hadoop file system; refuse if a file stands there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        raise FileExistsError(path)
    fs.mkdirs(target)


def webp(quality: int = 70) -> Callable:
    """An encoder of pixel arrays (height, width, 3) as WebP; needs Pillow, which is not part of the engine."""
    from io import BytesIO

    from PIL import Image

    def encode(pixels) -> bytes:
        out = BytesIO()
        Image.fromarray(pixels).save(out, "WEBP", quality=quality)
        return out.getvalue()

    return encode


def write_images(frames: DataFrame, path: str, encode: Callable[[bytes], bytes] | None = None, quality: int = 70) -> None:
    """Sink of rendered or rectified images: (oid, content, quality) as Parquet. ``encode`` turns a row's content into a file's
    bytes; without one the content is written as it is."""
    import pandas as pd

    def coded(batches):
        for pdf in batches:
            if encode is not None:
                pdf = pdf.assign(content=[encode(bytes(c)) for c in pdf["content"]])
            yield pd.DataFrame({"oid": pdf["oid"], "content": pdf["content"], "quality": quality})

    frames.select("oid", "content").mapInPandas(coded, "oid string, content binary, quality int").write.mode("overwrite").parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Sink of video frames (run_id, frame_seq, content and more) as Parquet, files and rows in the order of play, for an external muxer."""
    frames.repartitionByRange("run_id", "frame_seq").sortWithinPartitions("run_id", "frame_seq").write.mode("overwrite").parquet(path)


def dump(df: DataFrame, by: list[str], n: int = 20) -> None:
    """Print the first ``n`` rows in the given order, whole values; payloads are shown by their size."""
    shown = [F.concat(F.lit("<"), F.octet_length(f"`{f.name}`").cast("string"), F.lit(" bytes>")).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f"`{f.name}`") for f in df.schema]
    df.orderBy(*by).limit(n).select(*shown).show(n, truncate=False)


def run_paths(root: str, run: str) -> dict[str, str]:
    """Paths of one recorded run."""
    return {"point_cloud2": f"{root}/parquet/point_cloud2_{run}.parquet", "image": f"{root}/parquet/image_{run}.parquet", "images": f"{root}/images_{run}/", "rectified": f"{root}/rectified_{run}"}
