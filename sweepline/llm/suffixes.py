"""Operator 6: exact substring dedup by a common-prefix-aware distributed merge sort of sparse suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or earlier in
the same document). Sorting every suffix is not needed: each window of ``length`` bytes has an anchor, the place of
its smallest hash of ``GRAM`` bytes, which depends on the window alone, so equal windows have equal anchors. Only
anchors whose gram is repeated somewhere can hold a repeated window, and only their suffixes are sorted:

1. Grams at anchors are counted; the repeated ones become a sorted hash array on the shared storage.
2. Each task sorts the suffixes at repeated anchors into runs, cut at splitters. Of identical ones the first place goes on and
   the others are known to be repeats: their spans go out at once, so a passage with any number of places is a suffix a
   run. A run is exchanged front-coded: a suffix is its common prefix with the one before, and the rest.
3. The runs of a range are merged by a loser tree that keeps each run's common prefix with the last suffix
   that came out: a longer known prefix wins without a look at the bytes, equal ones are compared
   behind it only. Suffixes that come out with a whole gram in common are neighbours, and their windows
   (anchor minus offset) are held against each other; all but the first of equal windows are removed.
4. Removed spans meet the texts again by doc_id and a hash of the text.

Nulls and empty texts have no window. Ids are whole numbers (others raise); null ids come first. Rows with equal ids
and different texts are documents of their own, in the order of the hash of their text; rows with equal ids and texts
are one document, each treated alike. Long texts are worked on in overlapping stretches of ``STRETCH`` windows. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U, Spans, mix, ragged, slices
from .cdc import NO_ID
from .shared import Scratch, bits_for, cut, store_table, tidy

LENGTH, GRAM = 100, 40
RUN, RESOLVE, PER_RANGE = 60_000, 20_000, 30_000
STRETCH = 2 << 20


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Texts with the two numbers that order documents: the id (null: the smallest long) and a hash of the text."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id has to be a whole number: it sets the order of the documents")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sub"), "text", *more)


def _stretches(column, length: int):
    """As ``slices``, with the place of the first byte; a text over STRETCH comes in parts that share length - 1 bytes."""
    for s, e, b, offs in slices(column):
        if len(b) <= STRETCH + length or e - s > 1:
            yield s, e, b, offs, 0
            continue
        for at in range(0, len(b) - length + 1, STRETCH):
            part = b[at : at + STRETCH + length - 1]
            yield s, e, part, np.array([0, len(part)]), at


# ---------------------------------------------------------------- anchors
def anchors(b: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(anchor, first window, last window, gram hash) for the windows of some texts, in order."""
    z = np.zeros(0, np.int64)
    if len(b) < length:
        return z, z, z, np.zeros(0, U)
    h = Spans(b, 31).every(gram)
    bits = U(max(20, int(len(h)).bit_length()))
    low = (U(1) << bits) - U(1)
    m = (h & ~low) | np.arange(len(h), dtype=U)  # the leftmost of equal hashes is the smallest
    span, w = length - gram + 1, 1
    while w * 2 <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < span:
        m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
    at = (m & low).astype(np.int64)  # by window start
    size = np.diff(offs)
    full = size >= length
    windows = ragged(offs[:-1][full], size[full] - length + 1)
    if not len(windows):
        return z, z, z, np.zeros(0, U)
    a = at[windows]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (windows[1:] != windows[:-1] + 1)])
    last = np.r_[new[1:], len(windows)] - 1
    return a[new], windows[new], windows[last], h[a[new]]


def _head(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at some places as a number that sorts as they do (made signed)."""
    out = np.zeros(len(at), U)
    for k in range(8):
        out = out << U(8) | b[at + k].astype(U)
    return (out ^ U(1 << 63)).view(np.int64)


def repeated_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, n, head): hashes of grams at two anchors or more; head is known for some hashes only, for splitters.

    Anchors have small hashes, so they are mixed anew: the leading bits of h deal evenly.
    """

    def run(batches):
        for batch in batches:
            for _, _, b, offs, _ in _stretches(batch.column(0), length):
                a, _, _, h = anchors(b, offs, length, gram)
                kinds, first, n = np.unique(h, return_index=True, return_counts=True)
                head = np.where(kinds & U(15) == 0, _head(b, a[first]), 0) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(kinds).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(head)], ["h", "n", "head"])

    rows = docs.select("text").mapInArrow(tidy(run), "h long, n int, head long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("head").alias("head")).where("n > 1")


# ---------------------------------------------------------------- runs
def _matrix(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Bytes at ``starts`` as zero-padded rows."""
    out = np.zeros((len(starts), width), np.uint8)
    mask = np.arange(width) < sizes[:, None]
    out[mask] = b[ragged(starts, sizes)]
    return out


class _Run:
    """Suffixes gathered by a task until they fill a run."""

    def __init__(self, length: int, splitters: np.ndarray):
        self.length, self.splitters = length, splitters
        self.held: list[tuple] = []
        self.n = 0

    def add(self, b, a, lo, hi, doc, sub, base):
        """Right parts (anchor to the end of the last window) and left parts (first window to anchor) with their places."""
        right = _matrix(b, a, hi + self.length - a, self.length)
        left = _matrix(b, lo, a - lo, self.length)
        self.held.append((right, left, hi + self.length - a, a - lo, doc, sub, a + base))
        self.n += len(a)

    def blocks(self):
        """(range, n, data): sorted runs; with a negative n, as many spans of repeats, dealt over the ranges."""
        if not self.n:
            return
        right, left, rn, ln, doc, sub, place = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        width = self.length
        text = np.ascontiguousarray(right).view(f"S{width}").ravel()
        rest = np.ascontiguousarray(left).view(f"S{width}").ravel()
        by = np.lexsort((place, sub, doc, ln, rn, rest, text))
        right, left, rn, ln, doc, sub, place = (x[by] for x in (right, left, rn, ln, doc, sub, place))
        differs = np.ones(len(by), bool)
        differs[1:] = (rn[1:] != rn[:-1]) | (ln[1:] != ln[:-1]) | (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1)
        new = np.flatnonzero(differs)
        head = new[np.cumsum(differs) - 1]
        late = np.flatnonzero((doc != doc[head]) | (sub != sub[head]) | (place != place[head]))
        ranges = len(self.splitters) + 1
        for k in range(0, len(late), 4096):
            o = late[k : k + 4096]
            yield int((doc[o[0]] ^ place[o[0]]) % ranges), -len(o), b"".join(x.astype("<i8").tobytes() for x in (doc[o], sub[o], place[o] - ln[o], place[o] + rn[o]))
        right, left, rn, ln, doc, sub, place = (x[new] for x in (right, left, rn, ln, doc, sub, place))
        same = right[1:] == right[:-1]
        common = np.where(same.all(1), width, same.argmin(1))
        common = np.minimum(common, np.minimum(rn[1:], rn[:-1]))
        lcp = np.r_[0, common]
        range_ = np.searchsorted(self.splitters, _heads(right), "right")
        edges = np.r_[0, np.flatnonzero(range_[1:] != range_[:-1]) + 1, len(range_)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e > s:
                k = lcp[s:e].copy()
                k[0] = 0
                cols = np.arange(width)
                tail = right[s:e][(cols >= k[:, None]) & (cols < rn[s:e, None])]
                before = left[s:e][cols < ln[s:e, None]]
                parts = [k.astype("u1"), rn[s:e].astype("u1"), ln[s:e].astype("u1"), *(x[s:e].astype("<i8") for x in (doc, sub, place)), tail, before]
                yield int(range_[s]), int(e - s), b"".join(p.tobytes() for p in parts)


def _heads(right: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(right[:, :8]).view(">u8").ravel().astype(U) ^ U(1 << 63)).view(np.int64)


class _Front:
    """Reader of a front-coded run."""

    def __init__(self, n: int, data: bytes):
        at = 0

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        self.lcp, self.rn, self.ln = (take("u1", n).tolist() for _ in range(3))
        self.doc, self.sub, self.place = (take("<i8", n).tolist() for _ in range(3))
        self.data, self.at = data, at
        self.left_at = at + sum(self.rn) - sum(self.lcp)
        self.i = -1
        self.n = n
        self.text = b""
        self.left = b""

    def next(self) -> int:
        """Go on to the next suffix: its common prefix with the one before, or -1 at the end."""
        self.i = i = self.i + 1
        if i >= self.n:
            return -1
        k, r, m = self.lcp[i], self.rn[i], self.ln[i]
        self.text = self.text[:k] + self.data[self.at : self.at + r - k]
        self.at += r - k
        self.left = self.data[self.left_at : self.left_at + m]
        self.left_at += m
        return k


def merge(runs: list[_Front]):
    """Yield (common prefix with the suffix before, run) in order; the run's reader stands at the suffix.

    A loser tree: each inner node keeps the run that lost there and its common prefix with the winner.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    for r in runs:
        r.next()
    live = [r.i < r.n for r in runs] + [False] * (size - k)
    loser = [-1] * size
    known = [0] * size  # of each run: common prefix with the last suffix that came out

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        if not live[a]:
            return b, a
        if not live[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, h = runs[a].text, runs[b].text, known[a]
        n = min(len(x), len(y))
        if x[h:n] == y[h:n]:
            h = n
        else:
            while x[h] == y[h]:  # unknown bytes only
                step = 16
                while step and x[h : h + step] != y[h : h + step]:
                    step //= 2
                h += step or 1
        first = len(x) <= len(y) if h == n else x[h] < y[h]
        a, b = (a, b) if first else (b, a)
        known[b] = h
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return w

    win = build(1) if size > 1 else 0
    while live[win]:
        yield known[win], runs[win]
        step = runs[win].next()
        live[win] = step >= 0
        known[win] = max(step, 0)
        node = (win + size) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


# ---------------------------------------------------------------- windows
def _spans_of(items: list[tuple], length: int):
    """Removed spans (doc, sub, start, end) among neighbouring suffixes: (text, left, doc, sub, place) each."""
    ln = np.array([len(x[1]) for x in items])
    rn = np.array([len(x[0]) for x in items])
    doc, sub, place = (np.array([x[k] for x in items], np.int64) for k in (2, 3, 4))
    buf = np.frombuffer(b"".join(x[1] + x[0] for x in items), np.uint8)
    begin = np.cumsum(ln + rn) - (ln + rn)
    per = ln + rn - length + 1  # windows, from the leftmost
    item = np.repeat(np.arange(len(items)), per)
    shift = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
    h = Spans(buf, 31).of(begin[item] + shift, begin[item] + shift + length)
    start = place[item] - ln[item] + shift
    by = np.lexsort((start, sub[item], doc[item], h))
    hs = h[by]
    group = np.cumsum(np.r_[True, hs[1:] != hs[:-1]]) - 1
    head = by[np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])][group]
    later = np.zeros(len(item), bool)
    later[by] = (doc[item[by]] != doc[item[head]]) | (sub[item[by]] != sub[item[head]]) | (start[by] != start[head])
    new = np.flatnonzero(np.r_[True, (later[1:] != later[:-1]) | (item[1:] != item[:-1])])
    stop = np.r_[new[1:], len(item)] - 1
    take = later[new]
    new, stop = new[take], stop[take]
    return doc[item[new]], sub[item[new]], start[new], start[stop] + length


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, sub, s, e): byte spans of the documents whose windows of ``length`` bytes all start earlier elsewhere.

    ``doc`` is the id, or the smallest long for null ids, ``sub`` a hash of the text. Spans may overlap.
    """
    if not 8 <= gram <= length <= 255:
        raise ValueError("8 <= gram <= length <= 255")
    grams = cut(repeated_grams(docs, length, gram))
    scratch = Scratch(docs.sparkSession, "grams")
    total = grams.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    table = store_table(grams, "h", {}, scratch, bits_for(total["kinds"], 100_000))
    ranges = max(1, min(65_536, max(docs.sparkSession.sparkContext.defaultParallelism, total["n"] // PER_RANGE)))
    marks = [i / ranges for i in range(1, ranges)]
    heads = grams.where("head <> 0").agg(F.percentile_approx("head", F.array(*map(F.lit, marks)), 100 * ranges)).first()[0] if marks else None
    splitters = np.unique(np.array(heads or [], np.int64))

    def sort(batches):
        run = _Run(length, splitters)

        def out():
            rows = list(run.blocks())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "n", "data"])

        for batch in batches:
            doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, e, b, offs, base in _stretches(batch.column(2), length):
                a, lo, hi, h = anchors(b, offs, length, gram)
                found, _ = table.find(mix(h))
                for k in range(0, len(a), RUN):
                    part = np.arange(k, min(k + RUN, len(a)))[found[k : k + RUN]]
                    if len(part):
                        row = np.searchsorted(offs, lo[part], "right") - 1
                        run.add(b, a[part], lo[part], hi[part], doc[s:e][row], sub[s:e][row], base - offs[row])
                    if run.n >= RUN:
                        yield from out()
        yield from out()

    def join(batches):
        runs: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for r, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n < 0:
                    yield rows(np.frombuffer(data, "<i8").reshape(4, -n))
                else:
                    runs.setdefault(r, []).append((n, data))
        for r in sorted(runs):
            items: list[tuple] = []
            for common, front in merge([_Front(*x) for x in runs.pop(r)]):
                if common < gram and len(items) >= RESOLVE:
                    yield rows(_spans_of(items, length))
                    items = []
                i = front.i
                items.append((front.text, front.left, front.doc[i], front.sub[i], front.place[i]))
            if items:
                yield rows(_spans_of(items, length))

    def rows(spans):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in spans], ["doc", "sub", "s", "e"])

    sorted_runs = _keyed(docs).mapInArrow(tidy(sort), "range int, n int, data binary")
    out = cut(sorted_runs.repartition(ranges, "range").mapInArrow(tidy(join), "doc long, sub long, s long, e long"))
    scratch.drop()
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[new], e[np.r_[new[1:], len(s)] - 1]


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, report: bool = False) -> DataFrame:
    """(doc_id, text as bytes without removed ones, removed spans); ``report`` gives digests instead of the bytes."""
    spans = repeated_spans(docs, length, gram)
    by_doc = spans.groupBy("doc", "sub").agg(F.collect_set(F.struct("s", "e")).alias("gone"))  # repeated rows have equal spans
    both = _keyed(docs, "doc_id").join(by_doc.hint("merge"), ["doc", "sub"], "left").select("doc_id", "text", "gone")

    def apply(batches):
        for batch in batches:
            out = []
            gone = batch.column(2)
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode()
                s = e = np.zeros(0, np.int64)
                if gone[i].is_valid:
                    pair = gone[i].values
                    s, e = _union(pair.field("s").to_numpy(), pair.field("e").to_numpy())
                keep = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                n = len(raw) - len(keep)
                if report:
                    out.append((name, len(raw), n, len(s), hashlib.sha256(keep).hexdigest()))
                else:
                    out.append((name, keep, [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    long, kind = pa.int64(), docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(docs.schema["doc_id"].dataType)
    if report:
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [own, long, long, long, pa.string()]
        return both.mapInArrow(tidy(apply), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    names, kinds = ["doc_id", "kept", "removed"], [own, pa.binary(), pa.list_(pa.struct([("start", long), ("end", long)]))]
    return both.mapInArrow(tidy(apply), f"doc_id {kind}, kept binary, removed array<struct<start: long, end: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents without the bytes covered by a 100-byte string that also starts earlier."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=True)
