"""Operator 1: interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash
arrays on the shared storage and memory-mapped by the workers that score.

Words get numbers, the more frequent the smaller (a sorted hash array of the vocabulary). An n-gram is exchanged as its
numbers, in sorted, difference-coded and compressed blocks. It is dealt by its context, so a bucket holds whole contexts; a
context all of whose words are hot (each would fill half a bucket) is dealt by the whole n-gram instead, and its totals are added
up in a second small step. So no bucket grows with the commonest word or the beginning of texts.

Order n counts occurrences; lower orders count distinct left extensions (Kneser-Ney), but n-grams that begin a text keep
their occurrences, as nothing extends them to the left. Discounts come from the counts of counts of each order. A word
never seen gets the uniform share 1 / (V + 1).

The arrays keep 40 bits of an n-gram's hash besides its bucket: of a million keys in a bucket, an n-gram that was never seen meets
one with a probability of 1e-6. Words keep 64 bits. Counts are of any size.

Nulls and empty texts count as the end token alone. An empty training set gives every token the
uniform share of a vocabulary of none (probability 1). Rows are independent: repeated rows count again.
Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import BLOCK, U, Spans, fold_case, mix, slices, words
from .shared import CACHES, HashTable, Scratch, bits_for, cut, put_array, tidy

ORDER = 3
BOS, EOS = U(0x5D1E0F3B2C4A6978), U(0x7A3C5E9F1B2D4860)
FIRST, UNKNOWN = 0, U((1 << 64) - 1)  # numbers of the beginning of a text and of words never seen
FLUSH, PER_BUCKET, PER_UNIGRAMS = 2_000_000, 1_000_000, 4_000_000
_GRAM = "order int, bucket int, n int, data binary"
DONE = 0  # order of rows that say what was written


# ---------------------------------------------------------------- tokens
def _tokens(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BOS, words, EOS of each text as hashes, and where each text begins (n + 1 values)."""
    starts, ends, first = words(b, offs)
    n = len(offs) - 1
    begin = first + 2 * np.arange(n + 1)
    tok = np.empty(begin[-1], U)
    inside = np.ones(len(tok), bool)
    inside[begin[:-1]] = inside[begin[1:] - 1] = False
    tok[begin[:-1]], tok[begin[1:] - 1] = BOS, EOS
    tok[inside] = Spans(b).of(starts, ends)
    return tok, begin


def _place(begin: np.ndarray) -> np.ndarray:
    """Position of each token within its text (BOS is 0)."""
    return np.arange(begin[-1]) - np.repeat(begin[:-1], np.diff(begin))


def _join(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context extended by a word."""
    return mix(ctx * U(0x9E3779B97F4A7C15) + word)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and for every place the index of its value."""
    by = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[by][1:] != x[by][:-1]
    back = np.empty(len(x), np.int64)
    back[by] = np.cumsum(new) - 1
    at = by[new]
    return x[at], at, back


def _hash(columns) -> np.ndarray:
    out = np.zeros(len(columns[0]), U)
    for c in columns:
        out = _join(out, c.astype(U, copy=False))
    return out


# ---------------------------------------------------------------- blocks of n-grams
def _sorted(columns: list[np.ndarray], n: np.ndarray, span: int):
    """Distinct n-grams in the order of their numbers (below ``span``), counts added up."""
    width, ranks = max(1, int(span - 1).bit_length()), columns
    if width * len(columns) > 64 and span <= 1 << 24:  # ranks among the numbers that occur need fewer bits
        rank = np.zeros(span, np.int32)
        for c in columns:
            rank[c] = 1
        rank = np.cumsum(rank, dtype=np.int32)
        ranks, width = [rank[c] for c in columns], int(rank[-1]).bit_length()
    if width * len(columns) <= 64:
        key = np.zeros(len(n), U)
        for c in ranks:
            key = key << U(width) | c.astype(U)
        by = np.argsort(key)
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
    else:
        by = np.lexsort(columns[::-1])
        new = np.r_[True, np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])]
    at = np.flatnonzero(new)
    return [c[by[at]] for c in columns], np.add.reduceat(n[by], at)


def _pack(columns, n) -> bytes:
    """Each column as differences while the columns before it stay the same; bytes of equal weight together."""
    same, out = np.ones(len(n) - 1, bool), []
    for c in columns:
        d = c.astype(np.int64)
        d[1:] -= np.where(same, d[:-1], 0)
        same &= c[1:] == c[:-1]
        out.append(d)
    width = 4 if max(int(d.max()) for d in [*out, n]) < 1 << 32 else 8
    raw = b"".join(np.ascontiguousarray(d.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes() for d in [*out, n])
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(order: int, n: int, data: bytes):
    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=width * n * (order + 1)), np.uint8).reshape(order + 1, width, n)
    whole = [np.ascontiguousarray(x.T).view(f"<u{width}").ravel().astype(np.int64) for x in raw]
    new, out = np.zeros(n, bool), []
    new[0] = True
    for d in whole[:-1]:
        total = np.cumsum(d)
        at = np.flatnonzero(new)
        c = total - np.repeat(total[at] - d[at], np.diff(np.r_[at, n]))
        new[1:] |= c[1:] != c[:-1]
        out.append(c)
    return out, whole[-1]


def _blocks(order: int, columns, n, deal):
    """Rows of sorted n-grams by bucket; ``deal`` gives the bucket of each."""
    bucket = deal(columns)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    for s, e in zip(edges, np.r_[edges[1:], len(by)] if len(by) else edges, strict=True):
        own = by[s:e]
        yield order, int(bucket[own[0]]), len(own), _pack([c[own] for c in columns], n[own])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["order", "bucket", "n", "data"])


class _Dealer:
    """The bucket of an n-gram: by its context, or as a whole where all words of the context are hot."""

    def __init__(self, bits: int, hot: int, span: int, wide: int):
        self.bits, self.hot, self.span, self.wide = bits, hot, span, wide

    def parts(self, columns):
        """(bucket, 40 bits of the n-gram's hash, hash of the context, whether it is hot)."""
        ctx = _hash(columns[:-1])
        whole = _join(ctx, columns[-1].astype(U, copy=False))
        hot = np.logical_and.reduce([c < self.hot for c in columns[:-1]])
        top = U(64 - self.bits)
        return (np.where(hot, whole >> top, ctx >> top)).astype(np.int64), (whole << U(self.bits)) >> U(24), ctx, hot

    def side(self, ctx):
        return (ctx >> U(64 - self.bits)).astype(np.int64), (ctx << U(self.bits)) >> U(24)

    def __call__(self, columns):
        return self.parts(columns)[0] if len(columns) > 1 else (columns[0] // self.wide).astype(np.int64)


# ---------------------------------------------------------------- arrays
def _put_part(path: str, key: np.ndarray, columns=()) -> None:
    """A bucket's file: sorted keys of 40 bits and counts (a byte each, larger ones apart)."""
    by = np.argsort(key)
    key = key[by]
    parts = [np.array([len(key), len(columns)], "<u8"), (key >> U(8)).astype("<u4"), (key & U(255)).astype("u1")]
    for c in columns:
        c = c[by]
        big = np.flatnonzero(c >= 255)
        parts += [np.minimum(c, 255).astype("u1"), np.array([len(big)], "<u8"), big.astype("<u8"), c[big].astype("<u8")]
    name = f"{path}.{uuid.uuid4().hex}"
    with open(name, "wb") as f:
        for p in parts:
            f.write(p.tobytes() + bytes(-p.nbytes % 8))
    os.replace(name, path)


class _Part:
    def __init__(self, path: str):
        raw, at = np.memmap(path, np.uint8, "r"), 0

        def take(dtype, n):
            nonlocal at
            out = raw[at : at + n * np.dtype(dtype).itemsize].view(dtype)
            at += out.nbytes + -out.nbytes % 8
            return out

        n, columns = map(int, take("<u8", 2))
        self.key, self.tag = take("<u4", n), take("u1", n)
        self.columns = []
        for _ in range(columns):
            small = take("u1", n)
            m = int(take("<u8", 1)[0])
            self.columns.append((small, take("<u8", m), take("<u8", m)))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``key`` that are held, their places)."""
        head, tag = (key >> U(8)).astype(np.uint32), (key & U(255)).astype(np.uint8)
        at = np.searchsorted(self.key, head)
        open_ = np.flatnonzero(at < len(self.key))
        open_ = open_[self.key[at[open_]] == head[open_]]
        rows, places = [], []
        while len(open_):
            hit = self.tag[at[open_]] == tag[open_]
            rows.append(open_[hit])
            places.append(at[open_[hit]])
            open_ = open_[~hit]  # the next key may begin alike
            at[open_] += 1
            open_ = open_[at[open_] < len(self.key)]
            open_ = open_[self.key[at[open_]] == head[open_]]
        z = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(places)) if rows else (z, z)

    def values(self, column: int, places: np.ndarray) -> np.ndarray:
        small, big, value = self.columns[column]
        out = small[places].astype(np.int64)
        if len(big):
            large = np.flatnonzero(out == 255)
            out[large] = value[np.searchsorted(big, places[large].astype(np.uint64))]
        return out


_part = lru_cache(maxsize=8192)(_Part)


class Parts:
    """Keys by bucket in files that are mapped; ``sizes`` has the keys of each bucket, so that a lost file is an error."""

    def __init__(self, path: str, bits: int, columns: int):
        self.path, self.columns, self.sizes = path, columns, np.zeros(1 << bits, np.int64)

    def find(self, bucket: np.ndarray, key: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Found flags and values; ``ordered``: the keys come by bucket and size."""
        found, out = np.zeros(len(key), bool), [np.zeros(len(key), np.int64) for _ in range(self.columns)]
        order = np.arange(len(key)) if ordered else np.argsort(bucket.astype(U) << U(40) | key)
        b = bucket[order]
        edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(b)] if len(b) else [], strict=True):
            if not self.sizes[b[s]]:
                continue
            part = _part(f"{self.path}/{b[s]}")
            if len(part.key) != self.sizes[b[s]]:
                raise OSError(f"{part}: {len(part.key)} keys, not {self.sizes[b[s]]}")
            rows, places = part.find(key[order[s:e]])
            rows = order[s:e][rows]
            found[rows] = True
            for k in range(self.columns):
                out[k][rows] = part.values(k, places)
        return found, out


@lru_cache(maxsize=256)
def _counts(path: str) -> np.ndarray:
    return np.memmap(path, "<u8", "r")


CACHES.extend([_part, _counts])


# ---------------------------------------------------------------- model
@dataclass
class Model:
    """What a worker needs: folders of the arrays and, by order, the totals."""

    order: int
    vocabulary: HashTable
    tokens: int
    types: int
    dealer: _Dealer
    path: str
    grams: dict[int, Parts] = field(default_factory=dict)
    sides: dict[int, Parts] = field(default_factory=dict)  # of contexts: continuations in all, and types seen once, twice, more
    lone: dict[int, Parts] = field(default_factory=dict)  # contexts with one continuation, seen once
    hot: dict[int, Parts] = field(default_factory=dict)
    stats: dict[int, dict[str, int]] = field(default_factory=dict)
    scratch: Scratch | None = None

    def drop(self) -> None:
        self.scratch.drop()

    def discounts(self, order: int) -> np.ndarray:
        """D(count), for counts 0, 1, 2 and 3 or more."""
        n = [0, *(self.stats[order][f"n{i}"] for i in (1, 2, 3, 4))]
        if not n[1] or not n[2]:
            return np.array([0, 0.5, 0.5, 0.5])
        y = n[1] / (n[1] + 2 * n[2])
        return np.array([0.0, *(float(np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k, 0.95 * k)) if n[k] else 0.5 * k for k in (1, 2, 3))])

    def numbers(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, occurrences) of words given by hash."""
        kinds, _, back = _distinct(tok)
        found, got = self.vocabulary.find(kinds, ordered=True)
        number = np.where(found, got["id"].astype(U), UNKNOWN)
        number[kinds == BOS] = FIRST
        return number[back], got["raw"].astype(np.int64)[back]

    def continuations(self, number: np.ndarray) -> np.ndarray:
        """Kneser-Ney count of single words."""
        kinds, _, back = _distinct(number)
        out = np.zeros(len(kinds), np.int64)
        known = np.flatnonzero(kinds != UNKNOWN)
        bucket = (kinds[known] // U(self.dealer.wide)).astype(np.int64)
        for k in np.unique(bucket).tolist():
            own = known[bucket == k]
            out[own] = _counts(f"{self.path}/1/{k}")[(kinds[own] - U(k * self.dealer.wide)).astype(np.int64)]
        return out[back]

    def contexts(self, m: int, ctx: np.ndarray, hot: np.ndarray):
        """(known, continuations, types seen once, twice, more often) of contexts, given in the order of their hashes."""
        bucket, key = self.dealer.side(ctx)
        has, values = self.sides[m].find(bucket, key, ordered=True)
        rest = np.flatnonzero(~has & ~hot)
        one, _ = self.lone[m].find(bucket[rest], key[rest], ordered=True)
        rest = rest[one]
        has[rest], values[0][rest], values[1][rest] = True, 1, 1
        far = np.flatnonzero(hot)
        got, more = self.hot[m].find(bucket[far], key[far], ordered=True)
        has[far] = got
        for v, x in zip(values, more, strict=True):
            v[far] = x
        return has, *values

    def probabilities(self, tok: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(token | tokens before it in its text) and the training count, for all but the BOS tokens."""
        place = _place(begin)
        number, raw = self.numbers(tok)
        at = np.flatnonzero(place > 0)
        raw, place = raw[at], place[at]
        s, d = self.stats[1], self.discounts(1)
        total = s["adj"]
        count = self.continuations(number[at]) if self.types else np.zeros(len(at), np.int64)
        gamma = (d[1] * s["n1"] + d[2] * s["n2"] + d[3] * s["n3up"]) / total if total else 1.0
        p = np.maximum(count - d[np.minimum(count, 3)], 0) / max(total, 1) + gamma / (self.types + 1)
        for m in range(2, self.order + 1) if self.types else ():
            d = self.discounts(m)
            can = np.flatnonzero(place >= m - 1)
            bucket, key, ctx, hot = self.dealer.parts([number[at[can] - k] for k in range(m - 1, -1, -1)])
            known, first, back = _distinct(ctx)
            has, all_, n1, n2, n3 = self.contexts(m, known, hot[first])
            all_ = np.maximum(all_.astype(np.float64), 1)
            gamma = np.where(has, (d[1] * n1 + d[2] * n2 + d[3] * n3) / all_, 1.0)
            use = np.flatnonzero(has[back])
            _, (count,) = self.grams[m].find(bucket[use], key[use])
            part = np.zeros(len(can))
            part[use] = np.maximum(count - d[np.minimum(count, 3)], 0) / all_[back[use]]
            p[can] = part + gamma[back] * p[can]
        return p, raw


STATS = ["types", "adj", "n1", "n2", "n3", "n4", "n3up"]


def _figures(adj: np.ndarray) -> list[int]:
    return [len(adj), int(adj.sum()), *(int((adj == i).sum()) for i in (1, 2, 3, 4)), int((adj > 2).sum())]


def _done(order: int, bucket: int, *what: int):
    return DONE, bucket, order, np.array(what, "<i8").tobytes()


# ---------------------------------------------------------------- counting
def _words(batches):
    """(h, n): words and end tokens with their occurrences, summed over a partition."""
    held: list[tuple] = []

    def out():
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        by = np.argsort(h)
        h, n = h[by], n[by]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(n, at))], ["h", "n"])

    for batch in batches:
        for _, _, b, offs in slices(batch.column(0), 4 * BLOCK):
            tok, begin = _tokens(fold_case(b), offs)
            body = np.ones(len(tok), bool)
            body[begin[:-1]] = False
            held.append(np.unique(tok[body], return_counts=True))
            if sum(len(h) for h, _ in held) > FLUSH:
                yield out()
    if held:
        yield out()


def _vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[HashTable, int, int, list[tuple[int, int]]]:
    """The vocabulary array, tokens, types, and by class (the count's binary logarithm, falling) the number of the first word."""
    found = cut(docs.mapInArrow(tidy(_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    r = found.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    bits = bits_for(r["types"], 100_000, most=12)
    bucket = F.shiftrightunsigned("h", 64 - bits).cast("int")
    sized = found.select("h", "n", bucket.alias("b"), F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("c"))
    # a few dozen classes by at most 4096 buckets
    first, at = {}, FIRST + 1
    classes: list[tuple[int, int]] = []
    for x in sorted(sized.groupBy("c", "b").count().collect(), key=lambda x: (-x["c"], x["b"])):
        if not classes or classes[-1][0] != x["c"]:
            classes.append((x["c"], at))
        first[x["c"], x["b"]] = at
        at += x["count"]
    table = HashTable(scratch.path, bits, {"id": "<u4" if at < 1 << 32 else "<u8", "raw": "<u4" if r["tokens"] < 1 << 32 else "<u8"})

    def write(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        h, n, b, c = (t.column(k).to_numpy() for k in ("h", "n", "b", "c"))
        h = h.view(U)
        for k in np.unique(b).tolist():
            own = np.flatnonzero(b == k)
            own = own[np.lexsort((h[own], -c[own]))]
            kinds, begin, size = np.unique(-c[own], return_index=True, return_counts=True)
            number = np.arange(len(own)) + np.repeat([first[-x, k] for x in kinds.tolist()] - begin, size)
            by = np.argsort(h[own])
            table.write(k, h[own][by], id=number[by], raw=n[own][by])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int64())], ["b", "n"])

    for x in sized.repartition(1 << bits, "b").mapInArrow(tidy(write), "b int, n long").collect():  # a row a bucket
        table.sizes[x["b"]] = x["n"]
    return table, r["tokens"], r["types"], classes


def _count(model: Model):
    """The n-grams of all texts: occurrences of the highest order, and of the lower orders those that begin a text."""
    top, dealer, span = model.order, model.dealer, model.types + 1

    def run(batches):
        own = Model(model.order, model.vocabulary, model.tokens, model.types, model.dealer, model.path)
        held: dict[int, list] = {m: [] for m in range(2, top + 1)}
        size = 0

        def out():
            for m, parts in held.items():
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    if len(columns[0]):
                        rows = list(_blocks(m, *_sorted(columns, np.ones(len(columns[0]), np.int64), span), dealer))
                        yield _batch(rows)
                parts.clear()

        for batch in batches:
            for _, _, b, offs in slices(batch.column(0), 4 * BLOCK):
                tok, begin = _tokens(fold_case(b), offs)
                number = own.numbers(tok)[0].astype(np.int64)
                place = _place(begin)
                for m in held:
                    at = np.flatnonzero(place >= m - 1) if m == top else np.flatnonzero(place == m - 1)
                    held[m].append([number[at - k].astype(np.int32 if span < 1 << 31 else np.int64) for k in range(m - 1, -1, -1)])
                size += len(tok)
                if size > FLUSH:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _merge(m: int, model: Model):
    """Sum the blocks of a bucket, write its arrays; out go the n-grams of the next order down (each distinct n-gram is one left
    extension of its suffix), shares of the totals of hot contexts, and what was written."""
    dealer, span, path = model.dealer, model.types + 1, model.path

    def run(batches):
        parts: dict[int, list] = {}
        shares: dict[int, list] = {}
        for batch in batches:
            for order, k, n, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if order == m:
                    parts.setdefault(k, []).append((n, data))
                elif order == -(m + 1):
                    shares.setdefault(k, []).append(np.frombuffer(data, "<i8").reshape(5, -1))
                else:
                    yield _batch([(order, k, n, data)])
        for k, held in shares.items():
            rows = np.concatenate(held, axis=1)
            ctx, back = np.unique(rows[0], return_inverse=True)
            sums = [np.bincount(back, weights=x, minlength=len(ctx)).astype(np.int64) for x in rows[1:]]
            _put_part(f"{path}/{m + 1}/hot/{k}", dealer.side(ctx.view(U))[1], sums)
            yield _batch([_done(-(m + 1), k, len(ctx))])
        for k in sorted(parts):
            blocks = [_unpack(m, n, d) for n, d in parts.pop(k)]
            columns, n = [np.concatenate(c) for c in zip(*(b[0] for b in blocks), strict=True)], np.concatenate([b[1] for b in blocks])
            del blocks
            if m == 1:
                base = k * dealer.wide
                adj = np.bincount(columns[0] - base, weights=n, minlength=min(dealer.wide, span - base)).astype(np.int64)
                put_array(f"{path}/1/{k}", adj.astype("<u8"))
                yield _batch([_done(1, k, *_figures(adj[adj > 0]))])
                continue
            columns, n = _sorted(columns, n, span)
            _, key, ctx, hot = dealer.parts(columns)
            _put_part(f"{path}/{m}/grams/{k}", key, [n])
            at = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])])  # sorted by context
            side = [np.add.reduceat(x, at, dtype=np.int64) for x in (n, n == 1, n == 2, n > 2)]
            ctx, hot = ctx[at], hot[at]
            lone = ~hot & (side[0] == 1)
            more = ~hot & ~lone
            _put_part(f"{path}/{m}/lone/{k}", dealer.side(ctx[lone])[1])
            _put_part(f"{path}/{m}/sides/{k}", dealer.side(ctx[more])[1], [x[more] for x in side])
            yield _batch([_done(m, k, *_figures(n), int(more.sum()), int(lone.sum()))])
            if hot.any():
                share = np.array([ctx[hot].view(np.int64), *(x[hot] for x in side)])
                to = dealer.side(ctx[hot])[0]
                by = np.argsort(to, kind="stable")
                edges = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])
                yield _batch([(-m, int(to[by[s]]), int(e - s), share[:, by[s:e]].astype("<i8").tobytes()) for s, e in zip(edges, np.r_[edges[1:], len(by)], strict=True)])
            yield _batch(list(_blocks(m - 1, *_sorted(columns[1:], np.ones(len(n), np.int64), span), dealer)))

    return run


def train(docs: DataFrame, text: str = "text", order: int = ORDER, bits: int | None = None) -> Model:
    """Count the model over all rows of ``docs``. ``bits`` sets the number of buckets."""
    if order < 2:
        raise ValueError("order is 2 or more")
    spark, docs = docs.sparkSession, docs.select(text)
    scratch = Scratch(spark, "lm")
    vocabulary, tokens, types, classes = _vocabulary(docs, scratch)
    bits = bits_for(tokens, PER_BUCKET, least=5) if bits is None else bits
    # words that occur this often fill half a bucket; the beginning of texts (number 0) counts as one
    least = np.log2(max(tokens >> bits + 1, 1))
    hot = next((at for c, at in classes if c < least), types + 1)
    wide = max(1, min(PER_UNIGRAMS, types + 1))
    model = Model(order, vocabulary, tokens, types, _Dealer(bits, hot, types + 1, wide), scratch.path, scratch=scratch)
    for m in range(2, order + 1):
        for name, tables, columns in (("grams", model.grams, 1), ("sides", model.sides, 4), ("lone", model.lone, 0), ("hot", model.hot, 4)):
            os.makedirs(f"{scratch.path}/{m}/{name}")
            tables[m] = Parts(f"{scratch.path}/{m}/{name}", bits, columns)
    os.makedirs(f"{scratch.path}/1")
    rows = docs.mapInArrow(tidy(_count(model)), _GRAM)
    for m in range(order, 0, -1):
        rows = rows.repartitionById(1 << bits, F.col("bucket")).mapInArrow(tidy(_merge(m, model)), _GRAM)
    model.stats = {m: dict.fromkeys(STATS, 0) for m in range(1, order + 1)}
    for r in rows.collect():  # a few numbers for each file written
        m, k, what = r["n"], r["bucket"], np.frombuffer(r["data"], "<i8").tolist()
        if m < 0:
            model.hot[-m].sizes[k] = what[0]
            continue
        for name, x in zip(STATS, what, strict=False):
            model.stats[m][name] += x
        if m > 1:
            model.grams[m].sizes[k], model.sides[m].sizes[k], model.lone[m].sizes[k] = what[0], what[-2], what[-1]
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, by the mmapped model."""
    scratch, model.scratch = model.scratch, None
    held = Model(**model.__dict__)
    model.scratch = scratch

    def run(batches):
        total, types = held.tokens, held.types
        for batch in batches:
            for s, e, b, offs in slices(batch.column(1), 4 * BLOCK):
                tok, begin = _tokens(fold_case(b), offs)
                p, raw = held.probabilities(tok, begin)
                at = (begin - np.arange(len(begin)))[:-1]
                base = np.log10((raw + 0.1) / (total + 0.1 * (types + 1)))
                n = np.diff(begin) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(n), pa.array(np.add.reduceat(raw > 0, at, dtype=np.int64)), pa.array(np.full(e - s, total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id="doc_id", folds: int = 10, fold: int = 0):
    """crc32 of the id as text, modulo ``folds``, is ``fold`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def query(spark, sf_dir: str, order: int = ORDER) -> DataFrame:
    """op1: all texts scored by the model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()), order=order)
    out = cut(score(docs, model).withColumn("held_out", held_out()))
    model.drop()
    return out
