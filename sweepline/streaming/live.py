"""Live forms of the merge, the latest-state join and the two-frame history.

Spark hands rows over unordered within a micro-batch. Rows wait in the state of their run until the run's newest time is
``delay`` past theirs, then leave in merge order; what waits is bounded by the delay. No row is ever left out: the run keeps its
own edge instead of Spark's watermark, which drops what is older. A row that comes after its place is merged
where it comes and told by ``late``. A row of kind ``end`` at ``END_TS`` says that its run is whole and lets everything out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import CLOUD, IMAGE

END, END_TS = "end", 7_258_118_400_000_000_000  # the year 2200
MESSAGE = "run_id bigint, kind string, ts_ns bigint, seq bigint"
_COLUMNS = ["run_id", "kind", "ts_ns", "seq", "pos", "late", "pc_seq", "image_seq", "older_pos"]
_OUT = "run_id bigint, kind string, ts_ns bigint, seq bigint, pos bigint, late boolean, pc_seq bigint, image_seq bigint, older_pos bigint"


def read_messages(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of messages in the order they were written."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def merge_stream(messages: DataFrame, delay: str = "10 seconds", drop_first: bool = True) -> DataFrame:
    """Messages in merge order with ``pos``, the latest cloud and image at each, and the fused event before it.

    ``pc_seq`` and ``image_seq`` are null until both kinds were seen; ``older_pos`` is null on the first fused event.
    """

    reach = pd.Timedelta(delay).value

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "eff": {}, "pos": -1 if drop_first else 0, "done": None, "latest": {}, "fused": None, "top": None}
        ended = False
        rows = []
        for pdf in batches:
            ended |= bool((pdf["kind"] == END).any())
            pdf = pdf[pdf["kind"] != END]
            rows += zip(pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["ts_ns"].tolist(), strict=True)
        held["top"] = max((t for *_, t in rows), default=held["top"]) if held["top"] is None else max([held["top"], *(t for *_, t in rows)])
        edge = None if ended or held["top"] is None else held["top"] - reach
        wait = held["wait"] + [[s, k, t] for s, k, t in rows]
        wait.sort()
        eff, line = dict(held["eff"]), []
        for s, k, t in wait:  # an early time rides with the row before it in its file
            eff[k] = max(eff.get(k, t), t)
            line.append((eff[k], k != IMAGE, s, k, t))
        line.sort()
        out, keep = [], []
        for e, _, s, k, t in line:
            if edge is not None and e > edge:
                keep.append([s, k, t])
                continue
            held["eff"][k] = max(held["eff"].get(k, e), e)
            late = held["done"] is not None and e < held["done"]
            held["done"] = max(held["done"] or e, e)
            pos = held["pos"]
            held["pos"] += 1
            if pos < 0:
                continue
            held["latest"][k] = s
            both = held["latest"].get(CLOUD) is not None and held["latest"].get(IMAGE) is not None
            out.append((key[0], k, t, s, pos, late, *((held["latest"][CLOUD], held["latest"][IMAGE], held["fused"]) if both else (None, None, None))))
            if both:
                held["fused"] = pos
        held["wait"] = keep
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"pc_seq": "Int64", "image_seq": "Int64", "older_pos": "Int64"})

    return messages.groupBy("run_id").applyInPandasWithState(step, _OUT, "held string", "append", GroupStateTimeout.NoTimeout)


def latest_state(merged: DataFrame) -> DataFrame:
    """(run_id, pos, ts_ns, pc_seq, image_seq) of the fused events."""
    return merged.where("pc_seq is not null and image_seq is not null").select("run_id", "pos", "ts_ns", "pc_seq", "image_seq")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, then stop; the result is Parquet in ``out``."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
