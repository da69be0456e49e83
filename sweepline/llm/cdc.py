"""Operator 4: substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last ``WINDOW`` bytes sets the chunk boundaries, so an insertion moves only the chunks
around it. A passage is a run of whole chunks of a text that has ``least`` bytes, and no fewer chunks would do; it
is known by a digest of all its bytes (128 bits of BLAKE2b). Of each chunk there are two, the one that begins with it and the one that ends
with it, so every repeated run of chunks of ``least`` bytes is covered to both its ends. The first place of a passage in
(doc_id, place) order stays; what later ones hold is removed. Only text that stood in one piece before goes:
chunks that were seen in different places do not add up to a passage, and a phrase or a short line that happens to repeat stays.

The rolling hash of all bytes of a batch takes log2(WINDOW) vector steps. Digests are summed before the shuffle, so
a passage shared by any number of documents is a row a batch; those seen more than once become sorted hash
arrays that a second pass over the texts maps into memory: no text is ever shuffled.

Boundaries never split a UTF-8 character. Null and empty texts have no chunk (a null text stays null). Ids are whole
numbers (others raise). Rows with equal doc_id are the same document: they don't remove each other at the same place.
Null ids come first. An empty table gives an empty result; all columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import atexit
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import BLOCK, Spans, byte_codes, slices
from .shared import HashTable, Scratch, bits_for, cut, store_table, tidy

WINDOW, AVERAGE, SHORTEST, LEAST = 16, 24, 8, 100
NO_ID = -(1 << 63)


def boundaries(b: np.ndarray, offs: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Starts of all chunks of some texts, and the end."""
    n = len(b)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    if not n:
        return np.zeros(1, np.int64)
    place = np.arange(n) - np.maximum.accumulate(np.where(first[:-1], np.arange(n), 0))
    gear = (byte_codes(5) >> np.uint64(32)).astype(np.uint32)
    h, w = gear[b], 1
    while w < WINDOW:
        add = h[:-w] << np.uint32(w)
        add[place[w:] < w] = 0
        h[w:] += add
        w *= 2
    at = np.flatnonzero(h < (1 << 32) // average) + 1
    at = at[at < n]
    at = at[(b[at] & 0xC0) != 0x80]
    # of candidates that crowd, the first stays: this looks at SHORTEST bytes only
    near = np.diff(at, prepend=-SHORTEST) < SHORTEST
    at = at[~near]
    at = at[place[at] >= SHORTEST]
    first[at] = True
    return np.flatnonzero(first)


def _passages(b, offs, average, least):
    """Digest, document row, start within the document and length of all passages."""
    edge = boundaries(b, offs, average)
    starts, ends = edge[:-1], edge[1:]
    row = np.searchsorted(offs, starts, "right") - 1
    # from each chunk on, and up to each chunk: as few chunks as have ``least`` bytes
    stop = np.searchsorted(ends, starts + least)
    begin = np.searchsorted(starts, ends - least, "right") - 1
    on = np.flatnonzero(stop < len(ends))
    on = on[row[stop[on]] == row[on]]
    up = np.flatnonzero(begin >= 0)
    up = up[row[begin[up]] == row[up]]
    both = np.unique(np.r_[on * len(ends) + stop[on], begin[up] * len(ends) + up])
    i, j = np.divmod(both, max(len(ends), 1))
    # one digest for equal passages of these texts: they are told apart by a fast hash and their length
    fast = Spans(b, 23).of(starts[i], ends[j])
    _, first, back = np.unique(fast, return_index=True, return_inverse=True)
    raw = b.tobytes()
    made = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[i][first].tolist(), ends[j][first].tolist(), strict=True))
    digest = np.frombuffer(made, "<i8").reshape(-1, 2)[back]
    return digest, row[i], starts[i] - offs[row[i]], ends[j] - starts[i]


def _ids(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def repeated_passages(docs: DataFrame, average: int = AVERAGE, least: int = LEAST) -> DataFrame:
    """(digest, more, doc, at, n): passages (both halves of the digest) seen at two places or more, and the first place."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            for s, e, b, offs in slices(batch.column(1), BLOCK):
                digest, row, at, _ = _passages(b, offs, average, least)
                doc = ids[s:e][row]
                by = np.lexsort((at, doc, digest[:, 1], digest[:, 0]))
                digest, doc, at = digest[by], doc[by], at[by]
                new = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(1)]) if len(digest) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(digest)])
                cols = [digest[new, 0], digest[new, 1], doc[new], at[new].astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["digest", "more", "doc", "at", "n"])

    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id has to be a whole number: it sets the order of the documents")
    passages = docs.select("doc_id", "text").mapInArrow(tidy(run), "digest long, more long, doc long, at int, n int")
    seen = passages.groupBy("digest", "more").agg(F.min(F.struct("doc", "at")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    return seen.select("digest", "more", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "n")


def _spans(table: HashTable, b, offs, ids, average, least):
    """Removed byte spans (starts, ends) of some texts."""
    digest, row, at, size = _passages(b, offs, average, least)
    found, first = table.find(np.ascontiguousarray(digest[:, 0]).view(np.uint64))
    found &= first["more"] == digest[:, 1]
    later = np.flatnonzero(found & ((first["doc"] != ids[row]) | (first["at"] != at)))
    if not len(later):
        z = np.zeros(0, np.int64)
        return z, z
    start = (offs[row] + at)[later]
    end = start + size[later]
    by = np.argsort(start, kind="stable")
    start, end, row = start[by], np.maximum.accumulate(end[by]), row[later][by]
    new = np.flatnonzero(np.r_[True, (start[1:] > end[:-1]) | (row[1:] != row[:-1])])
    return start[new], end[np.r_[new[1:] - 1, len(end) - 1]]


def deduplicate(docs: DataFrame, average: int = AVERAGE, least: int = LEAST, report: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut out of text (and n_chars counted anew where it is a column).

    ``report`` gives (doc_id, n_bytes, n_removed, n_spans, text) instead.
    """
    found = cut(repeated_passages(docs, average, least))
    scratch = Scratch(docs.sparkSession, "chunks")
    atexit.register(scratch.drop)  # the result reads it as long as the session may
    table = store_table(found, "digest", {"more": "<i8", "doc": "<i8", "at": "<i4"}, scratch, bits_for(found.count(), 50_000))
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            ids, column = _ids(batch.column(at_id)), batch.column(at_text)
            empty = column.is_null()
            for s, e, b, offs in slices(column, BLOCK):
                start, end = _spans(table, b, offs, ids[s:e], average, least)
                drop = np.zeros(len(b) + 1, np.int8)
                drop[start] += 1
                np.subtract.at(drop, end, 1)
                keep = np.cumsum(drop[:-1]) == 0
                kept = np.r_[0, np.cumsum(keep)][offs]
                text = pa.StringArray.from_buffers(e - s, pa.py_buffer(kept.astype("<i4").tobytes()), pa.py_buffer(b[keep].tobytes()))
                if empty.slice(s, e - s).true_count:
                    text = pa.array([None if x else t for x, t in zip(empty.slice(s, e - s).to_pylist(), text.to_pylist(), strict=True)], pa.string())
                size = np.diff(offs)
                if report:
                    per = np.bincount(np.searchsorted(offs, start, "right") - 1, minlength=e - s)
                    yield pa.RecordBatch.from_arrays([batch.column(at_id).slice(s, e - s), pa.array(size), pa.array(size - np.diff(kept)), pa.array(per), text], ["doc_id", "n_bytes", "n_removed", "n_spans", "text"])
                    continue
                cols = [c.slice(s, e - s) for c in batch.columns]
                cols[at_text] = text
                if at_chars is not None:
                    import pyarrow.compute as pc

                    cols[at_chars] = pc.utf8_length(text).cast(batch.schema.field(at_chars).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    if report:
        return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, text string")
    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents without the passages that earlier ones hold."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), report=True)
