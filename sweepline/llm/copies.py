"""Near-dedup for the pipeline: one document of each group of near copies stays.

Near copies share at least ``LEAST`` (4 of 5) of their shingles of five words (Jaccard). The links are exact: every pair that
could reach this share is counted on all its shingles, up to collisions of 64-bit hashes.

Each task writes the shingle sets of its texts to a file of the shared folder; rows carry the place of a set, no set
is shuffled. Two steps find the pairs:

* SimHash: the texts' fingerprints are linked by the Golay-code keys of operator 7 (``simhash.links``), and linked texts are
  verified; classes with an equal minimum of one of ``STARS`` hash functions meet the smallest of them as well. This joins most
  of a large group by a number of pairs in proportion to its size, but a fingerprint can't tell a share of 0.8 for certain.
* Prefixes: of two sets that share 4 of 5 in all, each has a shared shingle among its first ``n - ceil(4 n / 5) + 1``, in any one
  order of all shingles (prefix filter). The order puts shingles of many texts last, so what templates have in common meets
  nowhere unless a text is nearly all template. All members of a bucket are held against each other but those that are joined
  already and those whose sizes or places leave too few shingles to share. Buckets of up to ``FEW`` members send their pairs on
  (at most ``FEW`` a member); in larger ones the pairs are verified on the spot, the most central members first, and only
  the links that join something new leave the task. A bucket over ``BLOCK`` members is dealt into blocks, and each two
  blocks meet in a task of their own.

Texts with the same words in the same order are one class, compared once. Texts without words are one class. Null ids
are never removed; rows with equal ids stay or go together. An empty table gives an empty result; all columns are
kept as they are.
"""

from __future__ import annotations

import glob
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U, Spans, fold_case, mix, slices, words
from . import simhash
from .shared import HashTable, Scratch, bits_for, components, cut, forest, fresh, store_table, tidy
from .simhash import majority, shingles

SHINGLE, LEAST, STARS = 5, 0.8, 3
BLOCK, FEW, SLOTS = 4_096, 8, 20
MARKS = 1_024  # bits of the marks that rule pairs out
_SET = "file long, at long, n int"


# ---------------------------------------------------------------- shingle sets
def _sets(path: str):
    """(doc_id, class, fp, file, at, n, m0...): hash of the word sequence, SimHash, place of the sorted shingle hashes, their minima."""

    def run(batches):
        name, at, count, total = uuid.uuid4().int >> 65, 0, np.zeros(1 << SLOTS, np.int64), 0
        with open(f"{path}/{name}.sets", "wb") as out:
            for batch in batches:
                for s, e, b, offs in slices(batch.column(1)):
                    b = fold_case(b)
                    starts, ends, first = words(b, offs)
                    h = Spans(b, 61).of(starts, ends)
                    n = np.diff(first)
                    cls = np.zeros(len(n), U)
                    full = np.flatnonzero(n)
                    if len(full):
                        with np.errstate(over="ignore"):
                            place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(U)
                            cls[full] = mix(np.add.reduceat(mix(h + mix(place + U(1))), first[:-1][full]))
                    flat, starts, ends, first = shingles(b, offs, SHINGLE)
                    h = Spans(flat, 67).of(starts, ends)
                    fp = majority(h, first)
                    row = np.repeat(np.arange(e - s), np.diff(first))
                    by = np.lexsort((h, row))
                    h, row = h[by], row[by]
                    if len(h):
                        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                        h, row = h[new], row[new]
                    size = np.bincount(row, minlength=e - s)
                    begin = np.cumsum(size) - size
                    low = np.zeros((STARS, e - s), U)
                    if len(full):
                        with np.errstate(over="ignore"):
                            for k in range(STARS):
                                low[k, full] = np.minimum.reduceat(mix(h ^ mix(np.array([k + 1], U))), begin[full])
                    count += np.bincount((h >> U(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
                    total += len(h)
                    out.write(h.astype("<u8", copy=False).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(s, e - s), pa.array(cls.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(e - s, name)), pa.array(at + 8 * begin), pa.array(size.astype(np.int32))]
                        + [pa.array(x.view(np.int64)) for x in low],
                        ["doc_id", "class", "fp", "file", "at", "n"] + [f"m{k}" for k in range(STARS)],
                    )
                    at += 8 * len(h)
        # slots of shingles that many texts hold, for the order
        often = np.flatnonzero(count > 4 + 4 * total / (1 << SLOTS))
        np.save(f"{path}/{name}.part.npy", np.c_[often, count[often]])
        os.replace(f"{path}/{name}.part.npy", f"{path}/{name}.often.npy")

    return run


def _order(path: str) -> None:
    """By slot, how often its shingles are seen (a logarithm). Any table gives right results; this one gives small buckets."""
    seen = np.zeros(1 << SLOTS)
    for f in glob.glob(f"{path}/*.often.npy"):
        slot, n = np.load(f).T
        seen[slot] += n
    np.save(f"{path}/order.npy", np.minimum(255, 4 * np.log2(1 + seen)).astype(np.uint8))


class _Reader:
    """Sets by place; files are read, not mapped, so that a worker holds only what it works on."""

    def __init__(self, path: str):
        self.path, self.open = path, {}

    def __call__(self, file: int, at: int, n: int) -> np.ndarray:
        if file not in self.open:
            if len(self.open) >= 200:
                os.close(self.open.pop(next(iter(self.open))))
            self.open[file] = os.open(f"{self.path}/{file}.sets", os.O_RDONLY)
        got = os.pread(self.open[file], 8 * n, at)
        if len(got) != 8 * n:
            raise OSError(f"{self.path}/{file}.sets: {len(got)} bytes at {at}, not {8 * n}")
        return np.frombuffer(got, "<u8")

    def close(self) -> None:
        while self.open:
            os.close(self.open.popitem()[1])


# ---------------------------------------------------------------- candidates
def _prefixes(path: str, table: HashTable | None = None):
    """(key, class, component, n, i): the first shingles of sets in the common order; with ``table``, those it holds, and the sets' places."""

    def run(batches):
        read, order = _Reader(path), np.load(f"{path}/order.npy")
        try:
            for batch in batches:
                cls, comp, file, at, size = (c.to_numpy() for c in batch.columns)
                ends = np.cumsum(size.astype(np.int64))
                s = 0
                while s < len(cls):
                    e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 400_000, "right")))
                    h = np.concatenate([read(*x) for x in zip(file[s:e].tolist(), at[s:e].tolist(), size[s:e].tolist(), strict=True)])
                    n = size[s:e].astype(np.int64)
                    row = np.repeat(np.arange(e - s), n)
                    by = np.argsort(row << 8 | order[(h >> U(64 - SLOTS)).astype(np.int64)], kind="stable")  # sets are sorted by hash
                    i = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                    take = i < (n + 4 * n // -5 + 1)[row]
                    key, row, i = mix(h[by][take]), row[take], i[take]  # prefixes hold the smaller hashes: mixed, they deal evenly
                    if table is not None:
                        held, value = table.find(key)
                        key, row, i, blocks = key[held], row[held], i[held], value["blocks"][held]
                    out = [key.view(np.int64), cls[s:e][row], comp[s:e][row], n[row].astype(np.int32), i.astype(np.int32)]
                    names = ["key", "class", "comp", "n", "i"]
                    if table is not None:
                        out, names = [*out, file[s:e][row], at[s:e][row], blocks], [*names, "file", "at", "blocks"]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
                    s = e
        finally:
            read.close()

    return run


def _alike_sizes(n, m):
    """Whether sets of these sizes can share LEAST."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


class _Crowd:
    """Links among the members of large buckets, verified on whole sets; what is joined already is not compared again."""

    MOST = 1 << 18  # hashes read at a time
    MARKED = 100_000

    def __init__(self, path: str):
        self.read, self.root, self.marked = _Reader(path), {}, {}

    def find(self, c: int) -> int:
        up = self.root.get(c, c)
        while up != self.root.get(up, up):
            up = self.root[up]
        if up != c:
            self.root[c] = up
        return up

    def marks(self, cls, file, at, n) -> np.ndarray:
        """One bit for each of the values that the leading bits of a set's shingles take, by member."""
        out = np.zeros((len(cls), MARKS // 64), U)
        if len(self.marked) > self.MARKED:
            self.marked.clear()
        todo = []
        for k, c in enumerate(cls.tolist()):
            if (m := self.marked.get(c)) is not None:
                out[k] = m
            else:
                todo.append(k)
        for part in self._parts(np.array(todo, np.int64), n):
            h = self._sets(file, at, n, part)
            held = np.zeros((len(part), MARKS), bool)
            held[np.repeat(np.arange(len(part)), n[part]), (h >> U(64 - MARKS.bit_length() + 1)).astype(np.int64)] = True
            out[part] = np.packbits(held, axis=1).view(U)
            self.marked |= zip(cls[part].tolist(), out[part], strict=True)
        return out

    def _parts(self, who, n):
        s = 0
        while s < len(who):
            total = np.cumsum(n[who[s:]])
            e = s + max(1, int(np.searchsorted(total, self.MOST, "right")))
            yield who[s:e]
            s = e

    def _sets(self, file, at, n, who) -> np.ndarray:
        return np.concatenate([self.read(*x) for x in zip(file[who].tolist(), at[who].tolist(), n[who].tolist(), strict=True)])

    def links(self, own, cls, comp, n, i, file, at, apart: bool):
        """(component, component) of pairs that share LEAST; ``apart``: only members of different blocks are paired."""
        names, comp = np.unique(comp, return_inverse=True)
        root = np.array([self.find(c) for c in names.tolist()])[comp]
        if (root == root[0]).all():
            return
        marks = self.marks(cls, file, at, n)
        # a member whose marks are the most usual ones stands nearest to the others
        often = np.zeros(MARKS)
        for s in range(0, len(marks), 512):
            often += np.unpackbits(marks[s : s + 512].view(np.uint8).reshape(-1, MARKS // 8), axis=1).sum(0)
        usual = np.concatenate([np.unpackbits(marks[s : s + 512].view(np.uint8).reshape(-1, MARKS // 8), axis=1) @ often for s in range(0, len(marks), 512)])
        order = np.argsort(-usual / np.bitwise_count(marks).sum(1), kind="stable")
        for k, p in enumerate(order.tolist()):
            q = order[k + 1 :]
            q = q[root[q] != root[p]]
            if not len(q):
                if (root == root[0]).all():
                    return
                continue
            ok = _alike_sizes(n[p], n[q]) & (9 * np.minimum(n[p] - i[p], n[q] - i[q]) >= 4 * (n[p] + n[q]))
            if apart:
                ok &= own[q] != own[p]
            q = q[ok]
            # each mark that only one of the sets has is a shingle that only one has
            q = q[9 * np.bitwise_count(marks[q] ^ marks[p]).sum(1) <= n[q] + n[p]]
            if not len(q):
                continue
            x = self.read(int(file[p]), int(at[p]), int(n[p]))
            for part in self._parts(q, n):
                part = part[root[part] != root[p]]
                if not len(part):
                    continue
                h = self._sets(file, at, n, part)
                hit = x[np.minimum(np.searchsorted(x, h), len(x) - 1)] == h
                shared = np.add.reduceat(hit, np.cumsum(n[part]) - n[part], dtype=np.int64)
                near = part[9 * shared >= 4 * (n[part] + n[p])]
                for r in np.unique(root[near]).tolist():
                    if r != root[p]:
                        low, high = sorted((r, int(root[p])))
                        yield low, high
                        self.root[high] = low
                        root[(root == low) | (root == high)] = low


def _meet(path: str):
    """Rows sorted by bucket: (0, class, class), pairs of small buckets whose sizes and places allow the share; (1, component,
    component), links within large ones. Pairs of one component are left out."""

    def pairs(x, y, col):
        """Of candidate places x, y: (smaller class, larger class) of those that may be near copies."""
        _, a, b, own, cls, comp, n, i, _, _ = col
        ok = (comp[x] != comp[y]) & ((a[x] == b[x]) | (own[x] != own[y])) & _alike_sizes(n[x], n[y])
        ok &= 9 * np.minimum(n[x] - i[x], n[y] - i[y]) >= 4 * (n[x] + n[y])
        x, y = cls[x[ok]], cls[y[ok]]
        return np.c_[np.minimum(x, y), np.maximum(x, y)]

    def send(kind, uv):
        uv = np.unique(uv, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(uv), kind, np.int32)), pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], ["kind", "u", "v"])

    def out(col, crowd):
        if not len(col[0]):
            return
        at = np.flatnonzero(np.r_[True, _differ(col)])
        size = np.diff(np.r_[at, len(col[0])])
        group = np.repeat(np.arange(len(at)), size)
        x = np.flatnonzero(np.repeat(size <= FEW, size))
        found = []
        for s in range(1, FEW):
            x = x[x + s < len(group)]
            x = x[group[x] == group[x + s]]
            if not len(x):
                break
            found.append(pairs(x, x + s, col))
        if found and len(found := np.concatenate(found)):
            yield send(0, found)
        for s, n in zip(at[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            _, a, b, *rest = (c[s : s + n] for c in col)
            if links := list(crowd.links(*rest, apart=bool(a[0] != b[0]))):
                yield send(1, np.array(links, np.int64))

    def run(batches):
        held, crowd = None, _Crowd(path)
        try:
            for batch in batches:
                col = [c.to_numpy().astype(np.int64, copy=False) for c in batch.columns]
                if held is not None:
                    col = [np.r_[p, q] for p, q in zip(held, col, strict=True)]
                if not len(col[0]):
                    continue
                last = np.flatnonzero(np.r_[True, _differ(col)])[-1]
                yield from out([c[:last] for c in col], crowd)
                held = [c[last:] for c in col]
            if held is not None:
                yield from out(held, crowd)
        finally:
            crowd.read.close()

    return run


def _differ(col) -> np.ndarray:
    key, a, b = col[:3]
    return (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])


# ---------------------------------------------------------------- verification
def _alike(path: str):
    """Forests of the pairs that share at least LEAST, counted on whole sets."""

    def run(batches):
        read = _Reader(path)
        try:
            for batch in batches:
                keep, last, x = [], None, None
                for u, v in zip(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True), zip(*(batch.column(k).to_pylist() for k in (5, 6, 7)), strict=True), strict=True):
                    if u != last:
                        last, x = u, read(*u)
                    both = np.sort(np.concatenate([x, read(*v)]), kind="stable")
                    keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))  # shared / (all - shared) >= 4 / 5
                near = pa.array(keep, pa.bool_())
                u, v = forest(*(batch.column(k).filter(near).to_numpy() for k in (0, 4)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        finally:
            read.close()

    return run


def _links(pairs: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """Edges between the first ids of the classes in ``pairs(u, v)`` that are near copies."""
    side = lambda c: classes.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("rep", "file", "at", "n")))
    both = pairs.join(side("v").hint("merge"), "v").join(side("u").hint("merge"), "u")
    return both.select(*(f"{x}_{c}" for c in "uv" for x in ("rep", "file", "at", "n"))).mapInArrow(tidy(_alike(path)), "u long, v long")


def links(classes: DataFrame, path: str) -> DataFrame:
    """Edges (u, v) whose components are those of all near copies of ``classes(class, rep, fp, file, at, n, m0...)``."""
    near = classes.where("rep is not null and n > 0")
    alike = near.groupBy("fp").agg(F.min("class").alias("p"))
    golay = simhash.links(alike.select("fp", F.col("p").alias("rep"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same = near.select("class", "fp").join(alike.hint("merge"), "fp").where("class != p").select(F.col("p").alias("u"), F.col("class").alias("v"))
    stars = near.select("class", "n", F.explode(F.array(*(F.xxhash64(F.lit(k), f"m{k}") for k in range(STARS)))).alias("key"))
    low = cut(stars.groupBy("key").agg(F.min(F.struct("class", "n")).alias("p"), F.count("*").alias("c")).where("c > 1"))
    met = stars.join(low.hint("merge"), "key").where("class != p.class and 5 * least(n, p.n) >= 4 * greatest(n, p.n)")
    met = met.select(F.least("class", "p.class").alias("u"), F.greatest("class", "p.class").alias("v"))
    star = cut(_links(golay.unionByName(same).unionByName(met).distinct(), classes, path))

    comp = components(star)
    held = cut(near.join(comp.hint("merge"), near.rep == comp.node, "left").select("class", F.coalesce("component", "rep").alias("comp"), "file", "at", "n"))
    row = "key long, class long, comp long, n int, i int"
    keys = held.mapInArrow(tidy(_prefixes(path)), row).groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c"))
    keys = cut(keys.where("a != b").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    scratch = Scratch(classes.sparkSession, "prefixes")
    table = store_table(keys, "key", {"blocks": "<i4"}, scratch, bits_for(keys.count(), 50_000))
    rows = held.mapInArrow(tidy(_prefixes(path, table)), row + ", file long, at long, blocks int")
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(class), blocks) as int)")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "own", "class", "comp", "n", "i", "file", "at")
    rest = cut(rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(tidy(_meet(path)), "kind int, u long, v long"))
    few = cut(_links(rest.where("kind = 0").select("u", "v").distinct(), classes, path))
    scratch.drop()
    return star.unionByName(rest.where("kind = 1").select("u", "v")).unionByName(few)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id of its group of near copies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "sets")
    lows = [f"m{k}" for k in range(STARS)]
    sets = cut(docs.select("doc_id", "text").mapInArrow(tidy(_sets(scratch.path)), f"doc_id {kind}, class long, fp long, {_SET}, " + ", ".join(f"{m} long" for m in lows)))
    _order(scratch.path)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("rep"), "file", "at", "n"))).alias("p")
    classes = cut(sets.groupBy("class").agg(first, F.min("fp").alias("fp"), *(F.min(m).alias(m) for m in lows)).select("class", "p.*", "fp", *lows))
    comp = components(links(classes, scratch.path))
    scratch.drop()
    label = classes.join(comp.hint("merge"), classes.rep == comp.node, "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", "class").join(label.hint("merge"), "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, every column as it is."""
    name = fresh(docs, "gone")
    gone = cut(groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone[name], "left_anti")
