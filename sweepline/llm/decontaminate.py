"""Operator 2: benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Words are runs of letters and digits (A-Z folded, bytes above 127 count as letters), hashed to ``FEATURES``
features. A passage is ``2 * BLOCK_WORDS`` words of a text, one beginning every ``BLOCK_WORDS``; it is weighted by TF-IDF
with document frequencies counted over the passages of the whole corpus.

The latent space comes from a randomised SVD of all passages in one distributed pass: with random test vectors W
(FEATURES x RANK) the tasks sum Z = A'(A W), and the Nystrom form of Z gives the ``RANK`` leading singular vectors. Passages of texts
and of the benchmark are both projected into this space. A pair is a candidate if its cosine there reaches ``LATENT`` and it shares
words (a TF-IDF cosine of ``SHARED``, without which no subsequence of half the words is to be expected), or if the
TF-IDF cosine alone reaches ``CANDIDATE``: a space of this rank tells topics apart, but not all passages of one topic, so
on its own it would miss paraphrases or let nearly everything through (the README has figures). Passages under
``BLOCK_WORDS`` words need less. What is near is aligned word
by word with the benchmark passage: the longest common subsequence, each word counting its IDF, as a share
of the whole. A share of ``COPIED`` is a leak; one of ``PARAPHRASED`` is one if the passage's answer (its last sentence) is
found to ``ANSWERED`` as well.

The benchmark is read in blocks of at most ``MOST_PASSAGES`` passages, which is what a task is sent. Null and empty
texts and benchmark items hold no passage; items under ``FEWEST`` words must be found whole. Rows with equal ids
are judged each by itself. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U, Spans, fold_case, mix, ragged, slices
from .shared import cut, fresh, tidy

FEATURES, RANK, BLOCK_WORDS = 1 << 14, 64, 16
MOST_PASSAGES, USUAL, CELLS = 2_048, 512, 1 << 21
ITEM_WORDS, FEWEST = 64, 8
LATENT, SHARED, CANDIDATE = 0.9, 0.12, 0.2  # the README has their recall
COPIED, PARAPHRASED, ANSWERED = 0.75, 0.5, 0.5

_APART = np.zeros(256, bool)
_APART[[c for c in range(128) if not chr(c).isalnum()]] = True


def word_hashes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and the first word of each (n + 1 values)."""
    inside = ~_APART[b]
    n = len(b)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return Spans(fold_case(b), 41).of(starts, np.flatnonzero(end) + 1), np.searchsorted(starts, offs)


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> U(50)).astype(np.int64)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of BLOCK_WORDS words within each text, and the text of each block."""
    count = -(-np.diff(first) // BLOCK_WORDS)
    row = np.repeat(np.arange(len(count)), count)
    return first[row] + BLOCK_WORDS * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)), row


def _leads(start: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every other block of a text, where passages that don't overlap begin."""
    return (start - first[row]) // BLOCK_WORDS % 2 == 0


def _frequencies(batches):
    """Passages (pairs of blocks) that hold a feature, and their number at feature -1."""
    df, total = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, _, b, offs in slices(batch.column(0)):
            h, first = word_hashes(b, offs)
            if not len(h):
                continue
            start, row = _blocks(first)
            at = start[_leads(start, row, first)]
            key = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(h)])) * FEATURES + _features(h)
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]]]
            df += np.bincount(key & (FEATURES - 1), minlength=FEATURES)
            total += len(at)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[total, df[at]])], ["f", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF by feature, over all passages."""
    rows = docs.select("text").mapInArrow(tidy(_frequencies), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows
    df = np.zeros(FEATURES + 1)
    df[rows["f"]] = rows["n"]
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.01


def latent_space(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(vectors FEATURES x rank, singular values): randomised SVD of the TF-IDF passages of all texts.

    The test matrix is a sparse sign embedding: each feature has one random column and sign.
    """
    rng = np.random.default_rng(seed)
    column, sign = rng.integers(0, rank, FEATURES), rng.choice([-1.0, 1.0], FEATURES)
    test = np.zeros((FEATURES, rank))
    test[np.arange(FEATURES), column] = sign
    weight = idf.astype(np.float32)
    # the commonest features make a dense part of a slice's matrix, the rest a sparse one
    usual = np.sort(np.argsort(idf, kind="stable")[:USUAL])
    column_of = np.full(FEATURES, -1)
    column_of[usual] = np.arange(len(usual))

    def run(batches):
        z = np.zeros((rank, FEATURES), np.float32)
        for batch in batches:
            for _, _, b, offs in slices(batch.column(0), 1 << 19):
                h, first = word_hashes(b, offs)
                if not len(h):
                    continue
                f = _features(h)
                start, row = _blocks(first)
                at = start[_leads(start, row, first)]
                size = np.diff(np.r_[at, len(h)])
                passage = np.repeat(np.arange(len(at)), size)
                v = weight[f] / np.repeat(np.sqrt(np.add.reduceat(weight[f] ** 2, at)), size)
                y = np.bincount(column[f] * len(at) + passage, weights=v * sign[f], minlength=rank * len(at)).reshape(rank, -1).astype(np.float32)  # (A W)'
                dense = column_of[f]
                d = np.flatnonzero(dense >= 0)
                part = np.bincount(passage[d] * len(usual) + dense[d], weights=v[d], minlength=len(at) * len(usual)).astype(np.float32)
                z[:, usual] += y @ part.reshape(len(at), -1)
                by = np.flatnonzero(dense < 0)
                if not len(by):
                    continue
                by = by[np.argsort(f[by])]
                fs, v, passage = f[by], v[by], passage[by]
                new = np.flatnonzero(np.r_[True, fs[1:] != fs[:-1]])
                kinds = fs[new]
                for k in range(rank):  # A' (A W), a column at a time
                    z[k, kinds] += np.add.reduceat(y[k].take(passage) * v, new)
        for k in range(rank):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z[k].tobytes()])], ["k", "z"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(z.as_py(), np.float32).astype(np.float64)
        for k, z in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.tobytes()])], ["k", "z"])

    parts = docs.select("text").mapInArrow(tidy(run), "k int, z binary")
    z = np.zeros((FEATURES, rank))
    for r in parts.repartition(rank, "k").mapInArrow(tidy(add), "k int, z binary").collect():  # FEATURES x rank numbers
        z[:, r["k"]] = np.frombuffer(r["z"], np.float64)
    shift = 1e-7 * max(np.linalg.norm(z), 1e-12)
    z += shift * test
    core = test.T @ z
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.eye(rank) * max(np.trace(core), 1e-12))
    u, s, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Benchmark:
    """Passages of the items: words, latent weights by feature, answers."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, space: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.item, self.words, self.whole, self.answer = [], [], [], []
        vectors: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            sentence = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
            h = self._hash(text)
            tail = min(len(self._hash(sentence[-1])) if len(sentence) > 1 else -(-len(h) // 4), len(h)) if sentence else 0
            for s in range(0, max(1, len(h) - ITEM_WORDS // 2), ITEM_WORDS // 2):
                w = h[s : s + ITEM_WORDS]
                if not len(w):
                    continue
                self.item.append(item)
                self.words.append(w)
                self.whole.append(len(w) < FEWEST)
                self.answer.append(np.arange(s, s + len(w)) >= len(h) - tail)
                for k in range(0, max(1, len(w) - BLOCK_WORDS), BLOCK_WORDS):
                    vectors.append((len(self.item) - 1, w[k : k + 2 * BLOCK_WORDS]))
        self.of = np.array([p for p, _ in vectors], np.int64)
        # a short passage is a small part of the text's passage that holds it
        self.share = np.sqrt(np.minimum([len(w) / BLOCK_WORDS for _, w in vectors], 1.0)).astype(np.float32)
        own = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0, U)
        at = np.repeat(np.arange(len(vectors)), [len(w) for _, w in vectors])
        self.kinds, kind = np.unique(own, return_inverse=True)
        key, count = np.unique(kind * max(len(vectors), 1) + at, return_counts=True)
        kind, at = np.divmod(key, max(len(vectors), 1))
        weight = count * idf[_features(self.kinds)][kind]
        size = np.sqrt(np.bincount(at, weights=weight**2, minlength=len(vectors)))
        self.entries = kind, at, (weight / np.maximum(size[at], 1e-12)).astype(np.float32)
        self.space = space.astype(np.float32)
        inside = np.zeros((len(vectors), space.shape[1]), np.float32)
        np.add.at(inside, at, self.space[_features(self.kinds)[kind]] * weight[:, None].astype(np.float32))
        self.latent = _unit(inside)
        self._index()

    def __getstate__(self):
        keep = ("idf", "item", "words", "whole", "answer", "of", "share", "kinds", "entries", "space", "latent")
        return {k: getattr(self, k) for k in keep}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._index()

    def _index(self) -> None:
        kind, at, weight = self.entries
        count = np.bincount(kind, minlength=len(self.kinds))
        many = np.flatnonzero(count > 24)
        self.many = np.full(len(self.kinds), -1)
        self.many[many] = np.arange(len(many))
        self.common = np.zeros((len(many), len(self.of)), np.float32)
        wide = self.many[kind] >= 0
        self.common[self.many[kind[wide]], at[wide]] = weight[wide]
        self.passage, self.weight = at[~wide], weight[~wide]  # sorted by word
        self.count = np.where(self.many < 0, count, 0)
        self.first = np.cumsum(self.count) - self.count
        self.has = np.zeros(FEATURES, bool)
        self.has[_features(self.kinds)] = True

    @staticmethod
    def _hash(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return word_hashes(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, U)

    def candidates(self, h: np.ndarray, first: np.ndarray, least: float, latent: float = LATENT, shared: float = SHARED):
        """(first word of the passage, item passage, TF-IDF cosine, latent cosine) of all candidates.

        Passages are taken so many at a time that their table with all benchmark passages has ``CELLS`` cells. Words
        of many benchmark passages are counted by passage and enter by a product, the others one by one.
        """
        f = _features(h)
        start, row = _blocks(first)
        size = np.diff(np.r_[start, len(h)])
        pair = np.r_[row[1:] == row[:-1], False]  # this block and the next are a passage
        lone = np.r_[True, ~pair[:-1]] & ~pair  # the only block of its text
        whole = pair | lone
        low = min(shared, least)

        def passages(by_block):
            out = by_block.copy()
            out[:-1][pair[:-1]] += by_block[1:][pair[:-1]]
            return out

        norm = np.sqrt(passages(np.add.reduceat(self.idf[f] ** 2, start)))
        use = np.flatnonzero(self.has[f])
        kind = np.minimum(np.searchsorted(self.kinds, h[use]), len(self.kinds) - 1)
        hit = self.kinds[kind] == h[use]
        use, kind = use[hit], kind[hit]
        block, gain = np.searchsorted(start, use, "right") - 1, self.idf[f[use]]
        found, kinds = [], len(self.of)
        step = max(1, CELLS // kinds)
        for s in range(0, len(start), step):
            e = min(s + step + 1, len(start))  # the block behind belongs to the last passage
            o = slice(*np.searchsorted(block, (s, e)))
            b, k, g = block[o] - s, kind[o], gain[o]
            usual = self.many[k] >= 0
            seen = np.bincount(b[usual] * len(self.common) + self.many[k[usual]], weights=g[usual], minlength=(e - s) * len(self.common))
            dot = seen.reshape(e - s, -1).astype(np.float32) @ self.common
            n = self.count[k]
            entry = ragged(self.first[k], n)
            np.add.at(dot.ravel(), np.repeat(b, n) * kinds + self.passage[entry], np.repeat(g, n) * self.weight[entry])
            dot[:-1] += np.where(pair[s : e - 1, None], dot[1:], 0)
            end = min(s + step, len(start))
            dot = dot[: end - s]
            i, j = np.nonzero(dot >= np.where(whole[s:end], low * norm[s:end], np.inf)[:, None].astype(np.float32) * self.share)
            found.append((i + s, j, dot[i, j] / norm[i + s]))
        i, j, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        inside = self._inside(f, start, size, pair, i, j)
        keep = (cosine >= least * self.share[j]) | (inside >= latent) & (cosine >= shared * self.share[j])
        i, j = i[keep], j[keep]
        return start[i], self.of[j], cosine[keep], inside[keep]

    def _inside(self, f, start, size, pair, i, j) -> np.ndarray:
        """Cosine in the latent space of passages i and benchmark passages j."""
        out = np.zeros(len(i), np.float32)
        who, back = np.unique(i, return_inverse=True)
        by = np.argsort(back, kind="stable")
        edge = np.searchsorted(back[by], np.arange(0, len(who) + 1024, 1024))
        for k, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            a = who[1024 * k : 1024 * (k + 1)]
            n = size[a] + np.where(pair[a], size[np.minimum(a + 1, len(size) - 1)], 0)
            words = f[ragged(start[a], n)]
            x = _unit(np.add.reduceat(self.space[words] * self.idf[words, None], np.cumsum(n) - n))
            out[by[s:e]] = np.einsum("ij,ij->i", x[back[by[s:e]] - 1024 * k], self.latent[j[by[s:e]]])
        return out

    def align(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, passage: np.ndarray, answers: bool = False) -> np.ndarray:
        """Share of each item passage (or of its answer) found, in order, in a stretch of words."""
        longest = max(len(self.words[p]) for p in passage)
        words, gain = np.zeros((len(passage), longest), U), np.zeros((len(passage), longest), np.float32)
        for i, p in enumerate(passage.tolist()):
            n = len(self.words[p])
            words[i, :n] = self.words[p]
            gain[i, :n] = self.idf[_features(self.words[p])] * (self.answer[p] if answers else 1)
        width = int((end - begin).max())
        grid = np.zeros((len(begin), width), U)
        mask = np.arange(width) < (end - begin)[:, None]
        grid[mask] = h[ragged(begin, end - begin)]
        best = np.zeros((len(begin), width + 1), np.float32)
        for j in range(longest):
            hit = (grid == words[:, j, None]) & mask
            more = np.where(hit, best[:, :-1] + gain[:, j, None], 0)
            np.maximum(best[:, 1:], more, out=best[:, 1:])
            np.maximum.accumulate(best, axis=1, out=best)
        total = gain.sum(1)
        return np.where(total > 0, np.minimum(best[:, -1] / np.maximum(total, 1e-9), 1), 1.0)

    def possible(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Upper bound of ``align``: the words found in any order."""
        n = end - begin
        who = np.repeat(np.arange(len(n)), n)
        there = mix(h[ragged(begin, n)] ^ mix(who.astype(U)))
        m = np.array([len(self.words[p]) for p in passage])
        own = np.concatenate([self.words[p] for p in passage])
        of = np.repeat(np.arange(len(m)), m)
        found = np.isin(mix(own ^ mix(of.astype(U))), there)
        gain = self.idf[_features(own)]
        return np.bincount(of, weights=gain * found, minlength=len(m)) / np.maximum(np.bincount(of, weights=gain, minlength=len(m)), 1e-9)


def matches(docs: DataFrame, benchmark: DataFrame, candidate: float = CANDIDATE) -> DataFrame:
    """(doc_id, item_id, cosine, latent, lcs, answer, first_word): the leaked items of each contaminated document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, latent double, lcs double, answer double, first_word long"
    names = ["doc_id", "item_id", "cosine", "latent", "lcs", "answer", "first_word"]
    idf = inverse_frequencies(docs)
    space, _ = latent_space(docs, idf)
    result, block, size = None, [], 0

    def search(items):
        held = Benchmark(items, idf, space)

        def run(batches):
            for batch in batches:
                for s, e, b, offs in slices(batch.column(1)):
                    h, first = word_hashes(b, offs)
                    if not len(h) or not len(held.of):
                        continue
                    at, passage, cosine, inside = held.candidates(h, first, candidate)
                    if not len(at):
                        continue
                    row = np.searchsorted(first, at, "right") - 1
                    # windows next to each other look at the same words: the nearest of them will do
                    by = np.lexsort((at, passage, row))
                    at, passage, cosine, inside, row = at[by], passage[by], cosine[by], inside[by], row[by]
                    new = np.r_[True, (row[1:] != row[:-1]) | (passage[1:] != passage[:-1]) | (at[1:] > at[:-1] + BLOCK_WORDS)]
                    # a long run is cut, so that no place is far from the window that stands for it
                    start = np.flatnonzero(new)
                    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
                    group = np.cumsum(new | (rank % 3 == 0))
                    by = np.lexsort((-cosine, group))
                    keep = by[np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])]
                    at, passage, cosine, inside, row = at[keep], passage[keep], cosine[keep], inside[keep], row[keep]
                    size = np.array([len(held.words[p]) for p in passage])
                    begin = np.maximum(at - size - BLOCK_WORDS, first[row])
                    end = np.minimum(at + 3 * BLOCK_WORDS + size, first[row + 1])
                    found: dict[tuple[int, int], tuple] = {}
                    for k in range(0, len(at), 512):
                        m = np.arange(k, min(k + 512, len(at)))
                        m = m[held.possible(h, begin[m], end[m], passage[m]) >= PARAPHRASED]
                        if not len(m):
                            continue
                        lcs = held.align(h, begin[m], end[m], passage[m])
                        whole = np.array([held.whole[p] for p in passage[m]])
                        leak = np.where(whole, lcs > 0.999, lcs >= COPIED)
                        answer = np.ones(len(m))
                        ask = np.flatnonzero(lcs >= PARAPHRASED)
                        if len(ask):
                            answer[ask] = held.align(h, begin[m[ask]], end[m[ask]], passage[m[ask]], answers=True)
                        leak |= ~whole & (lcs >= PARAPHRASED) & (answer >= ANSWERED)
                        for i in np.flatnonzero(leak):
                            key = int(row[m[i]]), held.item[passage[m[i]]]
                            hit = float(lcs[i]), float(cosine[m[i]]), float(inside[m[i]]), float(answer[i]), int(at[m[i]] - first[row[m[i]]])
                            found[key] = max(found.get(key, hit), hit)
                    if found:
                        rows, values = list(found), list(found.values())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(s, e - s).take(pa.array([r for r, _ in rows])), pa.array([i for _, i in rows], pa.int64())]
                            + [pa.array([v[k] for v in values]) for k in (1, 2, 0, 3, 4)],
                            names,
                        )

        return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)

    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += max(1, len(r["text"]) // 100)
        if size >= MOST_PASSAGES:
            part = search(block)
            result, block, size = part if result is None else result.unionByName(part), [], 0
    if block or result is None:
        part = search(block)
        result = part if result is None else result.unionByName(part)
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without leaked items, every column as it is."""
    name = fresh(docs, "leaked")
    leaked = cut(matches(docs, benchmark).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(leaked.hint("merge"), docs["doc_id"] == leaked[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every pair of a document and a benchmark item that leaked into it."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
