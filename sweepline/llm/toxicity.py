"""Operator 9: toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lower-cases, takes accents and zero-width characters off, maps homoglyphs (Cyrillic, Greek, full-width
forms) and digits or signs that stand for letters to Latin letters, and puts a space for other punctuation.
The lexicon holds whole words and word beginnings whose log-odds among labelled texts are high; a hit inside an
exception phrase does not count. A text's hits are weighted, divided by its words, and put through a
logistic curve fitted on the same labelled texts.

The fit is bounded by its sample alone: at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled texts (smallest hash
of the id first), near copies among them counted once. Every term that a hundredth of the toxic ones hold and whose odds are high
enough is taken, and every phrase that is seen often enough in clean ones. Scoring reads every whole text.

Null and empty texts hold no hit. Labels that are null are left out; without toxic labels every score is 0.
Repeated rows are scored alike. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm import held_out
from .shared import cut, tidy

TOXIC_ROWS, CLEAN_ROWS = 8_000, 24_000
PREFIXES = range(4, 8)
THRESHOLD = 0.3

# Characters that look like, or stand for, a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])
    for c in range(0x21, 0x7F):
        if not chr(c).isalnum():
            out[c] = " "
    for c in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2040), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if c >= 0x2010 and c < 0x2040 or not base.strip():
            out[c] = " "
        elif base != chr(c):
            out[c] = LOOKALIKES.get(base, base)
    return out | {ord(k): v for k, v in LOOKALIKES.items()}


_FOLD = _table()


def fold(text: str | None) -> str:
    """Folded words, one space before, between and after them."""
    return " " + " ".join((text or "").lower().translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    """terms: " begin" or " word " to weight; exceptions: " phrase "; curve: intercept and slopes."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] | None = None

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the hits that no exception phrase covers."""
        if not len(automaton):
            return []
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(folded)]
        covers = sorted((s, e) for s, e, w in found if w is None)
        if not covers:
            return found
        begin, reach = [s for s, _ in covers], list(accumulate((e for _, e in covers), max))
        # of the phrases that begin no later than a hit, one ends as far as the farthest
        return [(s, e, w) for s, e, w in found if w is not None and not ((k := bisect_right(begin, s)) and reach[k - 1] >= e)]

    def feature(self, automaton, text: str | None) -> tuple[float, float]:
        """(log of weighted hits in a thousand words, 1 if there is any hit)."""
        folded = fold(text)
        hits = self.hits(automaton, folded)
        return float(np.log1p(1000 * sum(w for *_, w in hits) / max(folded.count(" ") - 1, 1))), float(bool(hits))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))


ROWS = 250  # texts taken out of a batch at a time


def _parts(batch, *columns):
    """Slices of a batch as lists of the given columns."""
    for s in range(0, batch.num_rows, ROWS):
        yield tuple(batch.column(c).slice(s, ROWS).to_pylist() for c in columns)


def _features(lexicon: Lexicon, automaton, batch, column: int) -> np.ndarray:
    return np.array([lexicon.feature(automaton, t) for (part,) in _parts(batch, column) for t in part]).reshape(-1, 2)


def _family(folded: str) -> int:
    """Smallest hash of five words in a row: near copies mostly share it."""
    w = folded.split()
    return min(xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(len(w) - 4, 1))) >> 1


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded set of labelled texts (text, toxic), families of near copies counted once."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = [F.xxhash64("doc_id"), "doc_id"]
    ids = y.where("toxic = 1").orderBy(*by).limit(TOXIC_ROWS).unionByName(y.where("toxic = 0").orderBy(*by).limit(CLEAN_ROWS))
    ids = cut(ids)  # at most TOXIC_ROWS + CLEAN_ROWS small rows: a bound for the broadcast

    def families(batches):
        for batch in batches:
            for texts, toxic in _parts(batch, 0, 1):
                folded = [fold(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), pa.array(toxic, pa.int32()), pa.array([_family(t) for t in folded], pa.int64())], ["folded", "toxic", "family"])

    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int"))
    return cut(found.mapInArrow(tidy(families), "folded string, toxic int, family long").dropDuplicates(["family", "toxic"]))


def _term_counts(batches):
    for batch in batches:
        for texts, toxic in _parts(batch, 0, 1):
            count: dict[str, list[int]] = {}
            for folded, y in zip(texts, toxic, strict=True):
                seen = set()
                for w in set(folded.split()):
                    seen.add(f" {w} ")
                    seen.update(" " + w[:n] for n in PREFIXES if len(w) > n)
                for t in seen:
                    count.setdefault(t, [0, 0])[y] += 1
            if count:
                clean, bad = zip(*count.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(clean), pa.array(bad)], ["term", "clean", "toxic"])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    ridge = np.array([1e-3, *[0.1] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn terms, exception phrases and curve. ``exceptions`` adds phrases in which hits don't count."""
    texts = sample(docs, labels)
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon()
    counts = texts.select("folded", "toxic").mapInArrow(tidy(_term_counts), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = max(4, int(0.01 * toxic))
    rows = counts.withColumn("odds", odds).where(f"toxic >= {least} and odds > 3").collect()  # bounded by the sample
    # a beginning gives way to a longer one, or to a whole word, with nearly its toxic texts and fewer clean ones
    better: dict[str, tuple[float, int]] = {}
    for r in rows:
        t = r["term"]
        for n in range(PREFIXES[0], len(t.strip()) + (t[-1] == " ")):
            if r["toxic"] > better.get(t[: n + 1], (0, 0))[0] or (r["toxic"] == better[t[: n + 1]][0] and r["clean"] < better[t[: n + 1]][1]):
                better[t[: n + 1]] = (r["toxic"], r["clean"])
    terms: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"].strip()), r["term"])):
        t = r["term"]
        more, fewer = better.get(t, (0, 0))
        if more >= 0.9 * r["toxic"] and fewer < r["clean"]:
            continue
        if not any(t[: n + 1] in terms for n in PREFIXES if n < len(t.strip()) + (t[-1] == " ")):
            terms[t] = float(r["odds"])
    lexicon = Lexicon(terms, tuple(" " + " ".join(fold(p).split()) + " " for p in exceptions))

    def contexts(batches):
        for batch in batches:
            a, count = lexicon.automaton(), {}
            for folded, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                for s, _, _ in lexicon.hits(a, folded):
                    stop = folded.find(" ", s + 1)
                    before = folded.rfind(" ", 0, s)
                    after = folded.find(" ", stop + 1)
                    if before >= 0:
                        seen.add(folded[before : stop + 1])
                    if after >= 0:
                        seen.add(folded[s : after + 1])
                for t in seen:
                    count.setdefault(t, [0, 0])[y] += 1
            if count:
                n0, n1 = zip(*count.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(n0), pa.array(n1)], ["term", "clean", "toxic"])

    phrases = texts.select("folded", "toxic").mapInArrow(tidy(contexts), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    learned = phrases.where("clean >= 5 and clean >= 20 * toxic").collect()
    lexicon.exceptions += tuple(sorted(r["term"] for r in learned))

    def features(batches):
        a = lexicon.automaton()
        for batch in batches:
            x = _features(lexicon, a, batch, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["x", "any", "y"])

    table = texts.select("folded", "toxic").mapInArrow(tidy(features), "x double, any double, y int").groupBy("x", "any", "y").count().toPandas()
    n = table["count"].to_numpy()
    xy = np.repeat(table[["x", "any", "y"]].to_numpy(), n, axis=0)
    lexicon.curve = _curve(xy[:, :2], xy[:, 2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of ``docs`` but text are left out: (doc_id, score)."""

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            x = _features(lexicon, a, batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.probability(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, every column as it is; learns as the query does."""
    lexicon = fit(docs.where(~held_out(folds=4, fold=2)), labels)

    def run(batches):
        a = lexicon.automaton()
        for batch in batches:
            x = _features(lexicon, a, batch, at)
            yield batch.filter(pa.array(lexicon.probability(x) < THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents scored; learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold_ = held_out(folds=4, fold=2)
    lexicon = fit(docs.where(~fold_), labels.where(~fold_))
    return score(docs, lexicon).withColumn("held_out", fold_).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
