"""Byte-level BPE over whole Arrow batches.

A text is cut where a run of white space follows other text: no token of the pre-tokenizer's pattern
crosses such a place, so the pieces can be encoded apart. The vocabulary's special strings are ordinary text, unless
``specials`` asks for what the untouched library does: an own id each, and the text between them encoded apart. Each distinct piece is encoded once and its ids
are gathered for every occurrence; the encoder is built from the vocabulary file of ``tokenizers`` and
gives the same ids (tests hold it against that library, which stays the fallback for other vocabularies).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .bytesnp import U, Spans, ragged

DEFAULT = "byte_bpe_50k.json"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Encoder:
    """encode(str) -> ids, and the byte length of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []) if t["content"] in special):
            raise ValueError(f"{path}: special strings that take in what stands around them")
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        of = _byte_of()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.encode = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def reference(path: str, specials: bool = False) -> Tokenizer:
    """The library's own tokenizer; unless ``specials``, special strings are ordinary text."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials
    return t


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _solid(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` surely is no white space of any script."""
    c = b[at]
    one, two = b[np.maximum(at - 1, 0)], b[np.maximum(at - 2, 0)]
    return (c > 32) & ~((c >= 0x80) & (((one == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((two >= 0xE1) & (two <= 0xE3))))


class _Known:
    """Ids of the pieces seen by this worker, by hash; emptied when it holds ``MOST``."""

    MOST = 600_000

    def __init__(self):
        self.keys = np.zeros(0, U)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def add(self, keys, counts, ids):
        if len(self.keys) + len(keys) > self.MOST:
            self.__init__()
        start = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32 if ids.size and ids.max() > 65535 else self.ids.dtype)])
        k = np.r_[self.keys, keys]
        by = np.argsort(k, kind="stable")
        self.keys, self.start, self.count = k[by], np.r_[self.start, start][by], np.r_[self.count, counts][by]


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    return _Known()


def _encode_pieces(enc: Encoder, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of distinct pieces."""
    n = len(starts)
    blank = _BLANK[b[starts]]
    head = b[starts]
    odd = ~_solid(b, ends - 1) | (~blank & ((head < 32) | (head == 0xC2) | ((head >= 0xE1) & (head <= 0xE3))))
    counts = np.zeros(n, np.int64)
    parts: list[np.ndarray | None] = [None] * n if odd.any() else []
    plain = np.flatnonzero(~odd)
    flat = np.zeros(0, np.int64)
    if len(plain):
        # a line break stands before a piece that begins with text; it is a token of its own
        lead = (~blank[plain]).astype(np.int64)
        size = ends[plain] - starts[plain] + lead
        src = ragged(starts[plain] - lead, size)
        joined = b[np.maximum(src, 0)]
        begin = np.cumsum(size) - size
        joined[begin[lead == 1]] = 10
        flat = np.array(enc.encode(joined.tobytes().decode("utf-8")), np.int64)
        edge = np.cumsum(enc.size[flat])
        stop = np.searchsorted(edge, begin + size)
        first = np.searchsorted(edge, begin + lead, "right")
        if not (np.array_equal(edge[stop], begin + size) and len(flat) == stop[-1] + 1):
            raise AssertionError("a token crosses the edge of a piece")
        counts[plain] = stop + 1 - first
        keep = ragged(first, counts[plain])
        flat = flat[keep]
    if parts:
        at = np.cumsum(counts) - counts
        for i in plain.tolist():
            parts[i] = flat[at[i] : at[i] + counts[i]]
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(enc.encode(b[starts[i] : ends[i]].tobytes().decode("utf-8")), np.int64)
            counts[i] = len(parts[i])
        flat = np.concatenate(parts)
    return flat, counts


def encode(b: np.ndarray, offs: np.ndarray, path: str, specials: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, one after another, and where each text's ids begin (n + 1 values)."""
    enc = encoder(path) if specials else None
    if enc is None or enc.find is None:
        return _encode(b, offs, path)
    met = [m for m in enc.find.finditer(b.tobytes())]
    at, ids = np.array([m.span() for m in met], np.int64).reshape(-1, 2), np.array([enc.special[m[0]] for m in met], np.int64)
    inside = np.searchsorted(offs, at[:, 0], "right") == np.searchsorted(offs, at[:, 1], "left")  # not across two texts
    at, ids = at[inside], ids[inside]
    if not len(at):
        return _encode(b, offs, path)
    edges = np.unique(np.r_[offs, at.ravel()])
    flat, first = _encode(b, edges, path)
    is_ = np.zeros(len(edges) - 1, bool)
    is_[np.searchsorted(edges, at[:, 0])] = True
    keep = ~np.repeat(is_, np.diff(first))
    count = np.where(is_, 1, np.diff(first))
    total = np.r_[0, np.cumsum(count)]
    out = np.zeros(total[-1], np.uint32)
    own = np.ones(len(out), bool)
    own[total[:-1][is_]] = False
    out[own] = flat[keep]
    out[~own] = ids
    return out, total[np.searchsorted(edges, offs)]


def _encode(b: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    if not len(b):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    cut = np.zeros(len(b) + 1, bool)
    at = np.flatnonzero(_BLANK[b[1:]]) + 1
    cut[at[_solid(b, at - 1)]] = True
    cut[offs] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.r_[starts[1:], len(b)]
    hashes = Spans(b).of(starts, ends)
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    known = _known(path)

    def lookup():
        if not len(known.keys):
            return np.zeros(len(kinds), np.int64), np.zeros(len(kinds), bool)
        at = np.minimum(np.searchsorted(known.keys, kinds), len(known.keys) - 1)
        return at, known.keys[at] == kinds

    at, has = lookup()
    if not has.all():
        new = ~has
        if len(known.keys) + new.sum() > known.MOST:
            known.__init__()
            new = np.ones(len(kinds), bool)
        rows = first[new]
        ids, counts = _encode_pieces(encoder(path), b, starts[rows], ends[rows])
        known.add(kinds[new], counts, ids)
        at, _ = lookup()
    count = known.count[at][back]
    ids = known.ids[ragged(known.start[at][back], count)].astype(np.uint32)
    total = np.r_[0, np.cumsum(count)]
    return ids, total[np.searchsorted(starts, offs)]
