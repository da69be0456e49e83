"""Operator 5: sum-of-squares bin packing of token sequences.

A document's ids (and a closing id 0) are cut into pieces of at most ``capacity`` ids, the first being
the shorter one. Pieces are placed one by one, the longest first, where the sum over residual gaps of the
squared number of open bins with that gap becomes smallest; a bin is opened only where no open one has room (in this
order that saves bins), and a full piece is a sequence of its own.

Pieces are dealt by a hash of (doc_id, piece, the crc of its ids) into groups of at most about ``GROUP`` pieces, each packed by one
task, so neither a source, a missing id nor a group of copies gathers in a task; each group leaves a few open bins.
A special string of the vocabulary in a text is its own id, as the library has it. Null and empty texts are the closing id
alone. Rows with equal doc_id and piece are placed apart. A null id is kept. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import BLOCK, slices
from .shared import fresh, tidy
from .tokens import default_path, encode

CAPACITY = 2048
GROUP = 50_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    path = tokenizer or default_path()

    def run(batches):
        for batch in batches:
            names = batch.column(0)
            for s, e, b, offs in slices(batch.column(1), BLOCK):
                ids, first = encode(b, offs, path, specials=True)
                first = first + np.arange(e - s + 1)  # a closing 0 after each document
                flat = np.zeros(first[-1], "<u4")
                body = np.ones(len(flat), bool)
                body[first[1:] - 1] = False
                flat[body] = ids
                n = np.diff(first)
                count = -(-n // capacity)
                row = np.repeat(np.arange(e - s), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = n - (count - 1) * capacity
                start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[row])
                at = first[:-1][row] + start
                parts = [flat[a : a + k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                crc = [zlib.crc32(p) for p in parts]
                cols = [names.slice(s, e - s).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                heads = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    heads.append("ids")
                yield pa.RecordBatch.from_arrays(cols, heads)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the order given."""
    open_ = np.zeros(capacity + 1, np.int64)  # bins by gap; neither empty nor full ones count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        # the sum changes by 1 - 2 N(g) for the gap that goes and 1 + 2 N(g - s) for the gap that comes
        after = open_[: capacity + 1 - s] * 2 + 1
        after[0] = 0
        gain = after + 1 - 2 * open_[s:]
        gain[open_[s:] == 0] = np.iinfo(np.int64).max
        gain[-1] = np.iinfo(np.int64).max - 1  # a new bin, where no open one has room
        k = int(gain.argmin())
        gap = k + s
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = stacks[gap].pop()
            open_[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if k:
            stacks[k].append(b)
            open_[k] += 1
    return bins, offsets


def most_pieces(docs: DataFrame, capacity: int, text: str = "text") -> int:
    """No fewer than the documents' pieces: an id has a byte or more."""
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return r["n"] + r["bytes"] // capacity


def place(parts: DataFrame, capacity: int = CAPACITY, most: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, length and ids_crc32; ``most``: a bound of their number."""
    groups = max(1, round((parts.count() if most is None else most) / GROUP))
    g = fresh(parts, "group")

    def pack(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(held["length"].to_numpy(), capacity)
        held["sequence_id"] = bins * groups + held[g].to_numpy()
        held["offset"] = offsets
        return held.drop(columns=g)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return parts.withColumn(g, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))).groupBy(g).applyInPandas(pack, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return place(pieces(docs, capacity, tokenizer, doc_id, text), capacity, most_pieces(docs, capacity, text))


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most ``capacity`` ids."""
    whole = pieces(docs, capacity, tokenizer, keep_ids=True).select("doc_id", "piece", "ids")
    at = pack(docs, capacity, tokenizer).select("doc_id", "piece", "sequence_id", "offset")
    found = at.join(whole, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents packed into sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
