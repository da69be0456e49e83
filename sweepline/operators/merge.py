"""Event-time merge of recorded streams, latest-state join and order checks.

Windows run within a ``run_id``: one recording. Rows need run_id, kind, ts_ns and seq (file order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLOUD, IMAGE = "pc", "image"


def tagged_union(**kinds: DataFrame) -> DataFrame:
    """Messages of several kinds as one table with ``kind``; columns that a kind lacks are null."""
    out = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def ordered_merge(messages: DataFrame, second: str = IMAGE, drop_first: bool = True) -> DataFrame:
    """Interleave two kinds by time, adding ``pos``.

    Each kind stays in file order: an early timestamp rides with the row before it. On equal times the
    ``second`` kind goes first. The very first message is consumed before anything comes out; ``drop_first=False`` keeps it.
    """
    rides = F.max("ts_ns").over(Window.partitionBy("run_id", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ordered = messages.withColumn("_eff", rides)
    line = Window.partitionBy("run_id").orderBy("_eff", F.when(F.col("kind") == second, 0).otherwise(1), "seq")
    numbered = ordered.withColumn("pos", (F.row_number().over(line) - 2 if drop_first else F.row_number().over(line) - 1).cast("bigint")).drop("_eff")
    return numbered.where("pos >= 0")


def until_other(merged: DataFrame, kinds: tuple[str, ...] = (CLOUD, IMAGE)) -> DataFrame:
    """Merged messages of a run up to the first one of another kind, which ends it."""
    others = F.max(F.when(~F.col("kind").isin(*kinds), 1).otherwise(0)).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return merged.withColumn("_ended", others).where("_ended = 0").drop("_ended")


def latest_state(merged: DataFrame) -> DataFrame:
    """(run_id, pos, ts_ns, pc_seq, image_seq): the newest of both kinds at every event that has both."""
    upto = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def newest(kind):
        return F.last(F.when(F.col("kind") == kind, F.col("seq")), ignorenulls=True).over(upto)

    return merged.select("run_id", "pos", "ts_ns", newest(CLOUD).alias("pc_seq"), newest(IMAGE).alias("image_seq")).where("pc_seq is not null and image_seq is not null")


def out_of_order(messages: DataFrame) -> DataFrame:
    """Rows that are earlier than the row before them in their file."""
    before = F.lag("ts_ns").over(Window.partitionBy("run_id", "kind").orderBy("seq"))
    return messages.withColumn("prev_ts_ns", before).where("ts_ns < prev_ts_ns")


def last_two(fused: DataFrame) -> DataFrame:
    """The positions of the newest two fused events, at each event: oldest first."""
    two = Window.partitionBy("run_id").orderBy("pos").rowsBetween(-1, 0)
    return fused.withColumn("recent", F.collect_list("pos").over(two))


def video_frames(fused: DataFrame, fps: int = 50) -> DataFrame:
    """Add the number of a run's frame (from 0, one a fused event) and the time in nanoseconds at which a video of ``fps`` shows it."""
    number = (F.row_number().over(Window.partitionBy("run_id").orderBy("pos")) - 1).cast("bigint")
    return fused.withColumn("frame_seq", number).withColumn("show_ns", F.expr(f"frame_seq * 1000000000 div {fps}"))
