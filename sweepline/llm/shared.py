"""Shared storage, mmapped sorted hash arrays and distributed connected components."""

from __future__ import annotations

import ctypes
import os
import shutil
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_folder


# ---------------------------------------------------------------- workers
def tidy(run):
    """A partition function that gives freed memory back when it ends: Spark keeps its Python workers."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


CACHES: list = []  # of mapped files: a worker that is kept must not hold files that are deleted


def release() -> None:
    for cache in CACHES:
        cache.cache_clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _libc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another libc
        return None


_TRIM = _libc_trim()


# ---------------------------------------------------------------- shared folder
def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


class Scratch:
    """A folder of plain files on the shared storage, seen alike by the driver and all executors.

    The folder must be mounted on the machines (``file:`` or a bare path); files are written
    under a temporary name and renamed, so a repeated task leaves one whole file.
    """

    def __init__(self, spark: SparkSession, tag: str):
        root = shared_folder(spark)
        if "://" in root and not root.startswith("file:"):
            raise ValueError(f"mmapped arrays need a mounted shared folder, not {root}")
        root = root.removeprefix("file://").removeprefix("file:")
        self.path = os.path.join(root, f"{tag}-{uuid.uuid4().hex}")
        os.makedirs(self.path)

    def drop(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


def put_array(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)


@lru_cache(maxsize=1024)
def _mapped(path: str, dtype: str):
    """A file's numbers, mapped; an absent file is an error, never an empty array."""
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


CACHES.append(_mapped)


class HashTable:
    """Sorted uint64 keys with value columns, one file per column and bucket (top ``bits`` bits of the key).

    ``sizes`` has the rows of each bucket; a bucket that has rows but no file raises.
    """

    def __init__(self, path: str, bits: int, cols: dict[str, str]):
        self.path, self.bits, self.cols = path, bits, cols
        self.sizes = np.zeros(1 << bits, np.int64)

    def write(self, bucket: int, keys: np.ndarray, **values: np.ndarray) -> None:
        put_array(f"{self.path}/{bucket}.key", keys.astype("<u8", copy=False))
        for c, dtype in self.cols.items():
            put_array(f"{self.path}/{bucket}.{c}", values[c].astype(dtype, copy=False))

    def find(self, keys: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Found flags and values (0 where absent) for any uint64 keys (``ordered``: they are sorted)."""
        n = len(keys)
        found = np.zeros(n, bool)
        out = {c: np.zeros(n, t) for c, t in self.cols.items()}
        if not n:
            return found, out
        order = np.arange(n) if ordered else np.argsort(keys)
        ks = keys[order]
        edges = np.searchsorted(ks >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if self.bits else np.array([0, n])
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            s, e = edges[b], edges[b + 1]
            if not self.sizes[b]:
                continue
            held = _mapped(f"{self.path}/{b}.key", "<u8")
            if len(held) != self.sizes[b]:
                raise OSError(f"{self.path}/{b}.key holds {len(held)} keys, not {self.sizes[b]}")
            at = np.searchsorted(held, ks[s:e])
            np.minimum(at, len(held) - 1, out=at)
            hit = held[at] == ks[s:e]
            rows = order[s:e][hit]
            found[rows] = True
            for c, t in self.cols.items():
                out[c][rows] = _mapped(f"{self.path}/{b}.{c}", t)[at[hit]]
        return found, out


def store_table(df: DataFrame, key: str, cols: dict[str, str], scratch: Scratch, bits: int) -> HashTable:
    """Write rows (one per key; longs taken as unsigned) as a HashTable: a shuffle by bucket, then one file set each."""
    table = HashTable(scratch.path, bits, cols)
    bucket = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)

    def write(batches):
        held: list[pa.RecordBatch] = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            b = t.column("_b").to_numpy()
            k = t.column(key).to_numpy().view("<u8")
            order = np.lexsort((k, b))
            b, k = b[order], k[order]
            vals = {c: t.column(c).to_numpy()[order] for c in cols}
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                table.write(int(b[s]), k[s:e], **{c: v[s:e] for c, v in vals.items()})
            yield pa.RecordBatch.from_arrays([pa.array(b[starts], pa.int32()), pa.array(np.diff(np.r_[starts, len(b)]), pa.int64())], ["bucket", "n"])

    rows = df.select(key, *cols, bucket.alias("_b")).repartition(1 << bits, "_b")
    for r in rows.mapInArrow(tidy(write), "bucket int, n long").collect():  # a row a bucket
        table.sizes[r["bucket"]] = r["n"]
    return table


def bits_for(rows: int, per: int, least: int = 4, most: int = 16) -> int:
    """Bucket bits so that a bucket holds about ``per`` rows."""
    return min(most, max(least, int(np.ceil(np.log2(max(rows, 1) / per))) if rows > per else least))


# ---------------------------------------------------------------- connected components
def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its local component) for the nodes of some edges; roots left out."""
    if not len(u):
        return u[:0], u[:0]
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            break
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contract(batches):
    """Replace the edges of a partition by the star forest of their components (batch by batch, then folded)."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        u, v = forest(np.r_[u, x], np.r_[v, y])
        if len(u) > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            u, v = u[:0], v[:0]
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``edges(u, v)``.

    A round is a large-star step (a node and its larger neighbours hang on the smallest of the
    neighbourhood) and a contraction of the edges that share their upper node, which does the
    small-star step; then a checkpoint. A hot node's neighbours are reduced by ``min`` before
    the shuffle; the smallest neighbours are cut off before they are joined with the edges, so that
    Spark can split the join at a hot node. Empty in, empty out; more than ``rounds`` rounds raise.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v")
    e = cut(e.mapInArrow(tidy(_contract), "u long, v long"))
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # every node and its larger neighbours hang on the smallest of the neighbourhood
        large = both.join(low.hint("merge"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep = low.where("u != m").select("u", F.col("m").alias("v"))
        e = cut(large.unionByName(keep).where("u != v").repartition("u").mapInArrow(tidy(_contract), "u long, v long"))
        now = e.agg(F.count("*"), F.countDistinct("u"), F.countDistinct("v"), F.sum(F.hash("u", "v").cast("long"))).first()
        tops, lower = e.select("v").distinct(), e.select(F.col("u").alias("v")).distinct()
        roots = tops.join(lower.hint("merge"), "v", "left_semi").limit(1).count() if now[0] == now[1] else 1
        if roots == 0 and now[0] == now[1] or tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
