"""Operator 3: token counts by separator scan of flat, unindexed token files.

``scan`` cuts each file into blocks of bytes, finds the end-of-document ids of a block with one vectorised
comparison, and stitches documents that cross blocks with a prefix scan: over the blocks of a file, the
running number of separators gives a document's place in its file, the running last separator its start. The scan
has two levels, blocks within groups of ``SPAN`` blocks and the groups of a file, and moves a few numbers a block; the places
of the separators stay where they were found and are joined with what the scan carries into their block.

A special string that stands in a text is ordinary text for ``write_flat``, so no text can forge a separator.
A token count leaves the separator out; ids after a file's last separator are one unterminated document.
Empty files give nothing; two separators in a row give an empty document. A file whose size is no multiple
of the id's width is refused. ``write_flat`` makes such files from texts (null: empty) and returns
which document has which place; extra columns are ignored, rows with equal ids are documents of their own.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesnp import BLOCK, slices
from .shared import Scratch, cut, tidy
from .tokens import default_path, encode

SEPARATOR = 50256  # <|endoftext|>
BLOCK_BYTES = 4 << 20
SPAN = 1_024


def write_flat(docs: DataFrame, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One file of ids a partition in ``folder`` (shared); (file, place, doc_id) of each document, files written."""
    path = tokenizer or default_path()

    def run(batches):
        name = f"{TaskContext.get().partitionId():06d}.bin"
        part, place = f"{folder}/{name}.{uuid.uuid4().hex}", 0
        with open(part, "wb") as out:
            for batch in batches:
                for s, e, b, offs in slices(batch.column(1), BLOCK):
                    ids, first = encode(b, offs, path)
                    first = first + np.arange(e - s + 1)
                    flat = np.full(first[-1], separator, dtype)
                    body = np.ones(len(flat), bool)
                    body[first[1:] - 1] = False
                    flat[body] = ids
                    flat.tofile(out)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (e - s)), pa.array(np.arange(place, place + e - s)), batch.column(0).slice(s, e - s)], ["file", "place", "doc_id"])
                    place += e - s
        os.replace(part, f"{folder}/{name}")

    kind = docs.schema[doc_id].dataType.simpleString()
    return cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"file string, place long, doc_id {kind}"))


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES, suffix: str = ".bin") -> DataFrame:
    """(file, place, start, n_tokens, terminated) of every document in the folder's token files."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    files = sorted((f, os.path.getsize(f"{folder}/{f}")) for f in os.listdir(folder) if f.endswith(suffix))
    if odd := [f for f, n in files if n % width]:
        raise ValueError(f"not whole ids of {width} bytes: {odd[:3]}")
    table = spark.createDataFrame(files, "file string, size long").where("size > 0")
    blocks = table.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("size - 1"), F.lit(step).cast("long"))).alias("at"))
    count = max(1, min(sum(-(-n // step) for _, n in files), 4 * spark.sparkContext.defaultParallelism + len(files)))

    def find(batches):
        for batch in batches:
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{folder}/{file}", "rb") as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(min(step, size - at)), dtype)
                seps = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([at]), pa.array([size // width]), pa.array([len(seps)], pa.int64()), pa.array([at // width + int(seps[-1]) if len(seps) else None], pa.int64()), pa.array([seps.astype("<u4").tobytes()])],
                    ["file", "at", "ids", "seps", "last", "found"],
                )

    found = cut(blocks.repartition(count, "file", "at").mapInArrow(tidy(find), "file string, at long, ids long, seps long, last long, found binary"))
    line = found.select("file", "at", "seps", "last", F.expr(f"at div {step * SPAN}").alias("span"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = line.groupBy("file", "span").agg(F.sum("seps").alias("s"), F.max("last").alias("l"))
    spans = spans.select("file", "span", F.coalesce(F.sum("s").over(earlier("file", "span")), F.lit(0)).alias("s0"), F.max("l").over(earlier("file", "span")).alias("l0"))
    own = line.select("file", "at", "span", F.coalesce(F.sum("seps").over(earlier("file", "span", "at")), F.lit(0)).alias("s1"), F.max("last").over(earlier("file", "span", "at")).alias("l1"))
    carried = own.join(spans.hint("merge"), ["file", "span"]).select("file", "at", (F.col("s0") + F.col("s1")).alias("place"), F.coalesce(F.coalesce("l1", "l0") + 1, F.lit(0)).alias("start"))
    tail = F.col("at") + F.lit(step) >= F.col("ids") * F.lit(width)
    scanned = found.join(carried.hint("merge"), ["file", "at"]).select("file", "at", "ids", "found", "place", "start", tail.alias("tail"))

    def stitch(batches):
        for batch in batches:
            for file, at, ids, raw, place, start, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seps = np.frombuffer(raw, "<u4").astype(np.int64) + at // width
                begin = np.r_[start, seps + 1]
                end = np.r_[seps, ids]
                n = len(seps) + (tail and begin[-1] < ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(place + np.arange(n)), pa.array(begin[:n]), pa.array((end - begin)[:n]), pa.array(np.arange(n) < len(seps))],
                    ["file", "place", "start", "n_tokens", "terminated"],
                )

    return scanned.mapInArrow(tidy(stitch), "file string, place long, start long, n_tokens long, terminated boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents written as flat token files, then counted by the scan."""
    folder = Scratch(spark, "flat")
    where = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder.path)
    out = cut(where.join(scan(spark, folder.path).hint("merge"), ["file", "place"]).select("doc_id", "n_tokens", "file", "place", "start"))
    folder.drop()
    return out
