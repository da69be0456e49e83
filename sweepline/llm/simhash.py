"""Operator 7: SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 21, 21 and 22 bits. Two fingerprints that
differ in at most two bits agree in one whole segment (pigeonhole), and the next segment, read as a
23-bit word, differs in at most two bits; the perfect Golay code (23, 12, 7) then gives both words a
codeword in common among those within distance four (one or six of them). So the join key is (segment
number, exact segment, index of a nearby codeword). Equal keys are verified by the true bit distance.

Only distinct fingerprints are joined, by the smallest id that has them; a bucket's verified pairs are
reduced to a spanning forest before they leave the task. A bucket with more than ``CROWD`` members is dealt into blocks of
about ``BLOCK``, and each two blocks (and each with itself) are compared in a task of their own: all pairs, no matter how many.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows share a
fingerprint. A row without an id gets the component of its fingerprint, but links nothing by itself.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U, fold_case, ragged, slices, words
from .shared import components, cut, forest, tidy

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
RADIUS = 2
CROWD, BLOCK, STEP = 512, 4096, 256


# ---------------------------------------------------------------- fingerprints
def shingles(b: np.ndarray, offs: np.ndarray, size: int):
    """Normalised bytes (words joined by single spaces), shingle starts and ends, and the first shingle by text."""
    starts, ends, first = words(b, offs)
    n = ends - starts
    flat = np.append(b, np.uint8(32))[np.minimum(ragged(starts, n + 1), len(b))]
    end = np.cumsum(n + 1) - 1
    flat[end] = 32
    start = end - n
    count = np.diff(first)
    per = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    at = ragged(first[:-1], per)
    last = np.minimum(at + size, np.repeat(first[1:], per)) - 1
    return flat, start[at], end[last], np.r_[0, np.cumsum(per)]


def fingerprints(b: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    flat, starts, ends, first = shingles(fold_case(b), offs, size)
    raw = flat.tobytes()
    h = np.fromiter(map(xxhash.xxh64_intdigest, [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], repeat(42)), U, len(starts))
    return majority(h, first)


def majority(h: np.ndarray, first: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """By text, the bits that are set in over half of its hashes; texts are taken ``most`` hashes at a time."""
    count = np.diff(first)
    out = np.zeros(len(count), U)
    s = 0
    while s < len(count):
        e = max(s + 1, int(np.searchsorted(first, first[s] + most, "right")) - 1)
        own = np.flatnonzero(count[s:e]) + s
        if len(own):
            set_ = np.zeros((len(own), 64), np.int64)
            for a in range(first[s], first[e], most):  # more than once for a long text only, which is alone
                bits = np.unpackbits(h[a : min(a + most, first[e])].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                set_ += bits.sum(0, dtype=np.int64) if len(own) == 1 else np.add.reduceat(bits, first[:-1][own] - first[s], axis=0, dtype=np.int64)
            out[own] = np.packbits(set_ * 2 > count[own, None], axis=1).view(">u8").ravel()
        s = e
    return out


def fingerprint(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the SimHash as a signed long."""

    def run(batches):
        for batch in batches:
            for s, e, b, offs in slices(batch.column(1)):
                fp = fingerprints(b, offs, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- Golay keys
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of three bytes of a word, and by remainder the error patterns of up to four bits (-1: none)."""
    unit = [1 << i for i in range(23)]
    for i in range(11, 23):
        r = 1 << i
        for k in range(i, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        unit[i] = r
    rem = np.zeros((3, 256), np.int64)
    for i in range(23):
        byte, bit = divmod(i, 8)
        rem[byte][np.arange(256) >> bit & 1 == 1] ^= unit[i]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for c in combinations(range(23), weight):
            r = 0
            for i in c:
                r ^= unit[i]
            if weight < 4 or _weight(found[r]) == 3:
                found[r].append(sum(1 << i for i in c))
    table = np.full((2048, 6), -1, np.int64)
    for r, patterns in enumerate(found):
        table[r, : len(patterns)] = patterns
    return rem, table, (table >= 0).sum(1)


def _weight(patterns: list[int]) -> int:
    return bin(patterns[0]).count("1") if patterns else 9


def golay_indices(words23: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the 12-bit indices of the codewords within distance four (six columns, -1: none)."""
    rem, table, _ = _golay()
    r = rem[0][words23 & 255] ^ rem[1][words23 >> 8 & 255] ^ rem[2][words23 >> 16]
    pattern = table[r]
    return np.where(pattern >= 0, (words23[:, None] ^ pattern) >> 11, -1)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of some fingerprints."""
    seg = [(fp >> U(s) & U((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = golay_indices(seg[(i + 1) % 3])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(i << 34 | seg[i][row] << 12 | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches):
    for batch in batches:
        fp, rep = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy()
        for s in range(0, len(fp), 20_000):
            row, key = keys_of(fp[s : s + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[s + row].view(np.int64)), pa.array(rep[s + row])], ["key", "fp", "rep"])


# ---------------------------------------------------------------- verification
_OUT = ["crowd", "key", "u", "v"]


def _rows(crowd: bool, key: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), crowd)), pa.array(key), pa.array(u), pa.array(v)], _OUT)


def _verify(batches):
    """Rows sorted by key: forests of the pairs within the radius; crowds go out as they are (u: fingerprint, v: id)."""
    key, fp, rep = (np.zeros(0, np.int64) for _ in range(3))
    crowd = None

    def links(key, fp, rep):
        us, vs = [], []
        at = np.arange(len(key) - 1)
        for s in range(1, CROWD):
            at = at[at + s < len(key)]
            at = at[key[at] == key[at + s]]
            if not len(at):
                break
            near = at[np.bitwise_count((fp[at] ^ fp[at + s]).view(U)) <= RADIUS]  # of signed numbers it counts the absolute value's
            us.append(rep[near])
            vs.append(rep[near + s])
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            if len(u):
                yield _rows(False, np.zeros(len(u), np.int64), u, v)

    for batch in batches:
        k, f, r = (c.to_numpy() for c in batch.columns)
        if crowd is not None:  # the rest of a crowd that has gone out
            more = np.searchsorted(k, crowd, "right")
            if more:
                yield _rows(True, k[:more], f[:more], r[:more])
            if more == len(k):
                continue
            k, f, r, crowd = k[more:], f[more:], r[more:], None
        key, fp, rep = np.r_[key, k], np.r_[fp, f], np.r_[rep, r]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        big = np.repeat(size > CROWD, size)
        if big.any():
            yield _rows(True, key[big], fp[big], rep[big])
            crowd = key[-1] if big[-1] else None
        last = np.repeat(np.arange(len(at)) == len(at) - 1, size)
        done = ~big & ~last
        yield from links(key[done], fp[done], rep[done])
        hold = last & ~big
        key, fp, rep = key[hold], fp[hold], rep[hold]
    yield from links(key, fp, rep)


def _blocks(batches):
    """Rows (key, a, b, own, fp, rep) sorted by (key, a, b): forests of the pairs within the radius of each two blocks."""
    held = None

    def links(col):
        _, a, b, own, fp, rep = col
        u = v = np.zeros(0, np.int64)
        for s in range(0, len(fp), STEP):
            near = np.bitwise_count((fp[s : s + STEP, None] ^ fp[None, s:]).view(U)) <= RADIUS
            i, j = np.nonzero(near)
            ok = (i < j) & ((a[0] == b[0]) | (own[s + i] != own[s + j]))
            u, v = forest(np.r_[u, rep[s + i[ok]]], np.r_[v, rep[s + j[ok]]])
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def out(col):
        if len(col[0]):
            at = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in col[:3]])])
            for s, e in zip(at, [*at[1:], len(col[0])], strict=True):
                yield from links([c[s:e] for c in col])

    for batch in batches:
        col = [c.to_numpy().astype(np.int64, copy=False) for c in batch.columns]
        if held is not None:
            col = [np.r_[p, q] for p, q in zip(held, col, strict=True)]
        if not len(col[0]):
            continue
        last = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in col[:3]])])[-1]
        yield from out([c[:last] for c in col])
        held = [c[last:] for c in col]
    if held is not None:
        yield from out(held)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints (fp, rep), with the components of all links within two bits."""
    pairs = (
        distinct.where("rep is not null").select("fp", "rep").mapInArrow(tidy(_emit_keys), "key long, fp long, rep long")
        .repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(_verify), "crowd boolean, key long, u long, v long")
    )
    pairs = cut(pairs)
    crowds = pairs.where("crowd").select("key", F.col("u").alias("fp"), F.col("v").alias("rep"))
    sizes = cut(crowds.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = crowds.join(sizes.hint("merge"), "key").withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) as int)")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "own", "fp", "rep")
    met = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(tidy(_blocks), "u long, v long")
    return pairs.where("not crowd").select("u", "v").unionByName(met)


def near_duplicates(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable by links of at most two bits."""
    fps = cut(fingerprint(docs, size, doc_id, text))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(links(distinct))
    label = distinct.join(comp.hint("merge"), distinct.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents with fingerprint (3-word shingles) and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
