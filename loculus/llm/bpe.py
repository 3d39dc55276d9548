"""Byte-level BPE encoding and decoding.

A piece (one match of the pre-tokenizer's pattern) is encoded over a segment tree: leaf i holds the rank of the pair
that starts at live byte position i, inner nodes hold the leftmost minimum below them. The root gives the next merge;
a merge changes the pair at its position and at its live left neighbour and removes the one of the right part, three
point updates of log2(length) nodes each. Many pieces of like length are encoded at once, a row of one matrix each,
so the updates are array operations; results are kept for pieces that recur, up to a bound.

Defined results: a null text is empty; an empty text has no ids and decodes to nothing; special-token strings in a
text are ordinary text; texts are never cut, and a single piece of any length is one (long) tree.
"""

from __future__ import annotations

import base64
import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_column, map_rows, to_bytes

#: Above every rank, as ids take 20 bits in a pair's key; NONE times the width of a tree must fit in 63 bits.
NONE = np.int64(1 << 20)


class Bpe:
    """Encoder and decoder for a table of ranks in the .tiktoken format."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 300_000):
        if max(ranks.values()) >= NONE:
            raise ValueError(f"ranks must be below {NONE}")
        self.ranks, self.pattern, self.keep = ranks, regex.compile(pattern), keep
        self.vocab = {r: b for b, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._pairs()
        self.seen: dict[str, tuple[int, bytes, bytes]] = {}

    def fresh(self) -> Bpe:
        """The same tables with a memory of pieces of its own, which a task's end sets free."""
        other = copy.copy(self)
        other.seen = {}
        return other

    @classmethod
    def load(cls, path: str, pattern: str, **kw) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern, **kw)

    def _pairs(self) -> None:
        """An open-addressing table (left id, right id) -> rank of the joined token."""
        keys, vals = [], []
        for b, r in self.ranks.items():
            for k in range(1, len(b)):
                left, right = self.ranks.get(b[:k]), self.ranks.get(b[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    vals.append(r)
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        self.probes = 1
        k, v = np.array(keys, np.int64), np.array(vals, np.int64)
        at = self._slot(k)
        while len(k):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(k), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.vals[at[put]] = k[put], v[put]
            k, v, at = k[~put], v[~put], (at[~put] + 1) & self.mask
            self.probes += bool(len(k))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't join; negative ids join nothing."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left << 20 | right)
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes + 1):
            k = self.keys[at[todo]]
            hit = k == key[todo]
            out[todo[hit]] = self.vals[at[todo[hit]]]
            todo = todo[~hit & (k != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces must be of at least one byte."""
        out: list[list[int]] = [[]] * len(pieces)
        lens = np.array([len(p) for p in pieces])
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(int))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, 200_000 // int(w))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._trees([pieces[i] for i in part], int(w)), strict=True):
                    out[i] = ids
        return out

    def _trees(self, pieces: list[bytes], w: int) -> list[list[int]]:
        n = len(pieces)
        lens = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(n, w)
        pos = np.arange(w)
        live = pos < lens[:, None]
        ids = np.where(live, self.byte[raw], -1)
        nxt = np.where(live, pos + 1, w)  # next live position; lens and beyond: none
        prv = np.broadcast_to(pos - 1, (n, w)).copy()
        pair = np.full((n, w), NONE)
        pair[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, w - 1)
        # A node is rank * w + position: its minimum is the least rank and of those the leftmost.
        tree = np.full((n, 2 * w), NONE * w)
        tree[:, w:] = pair * w + pos
        for k in range(w.bit_length() - 2, -1, -1):
            a = 1 << k
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        flat_t, flat_i, flat_n, flat_p = tree.reshape(-1), ids.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        rows = np.arange(n)
        limit = NONE * w

        def update(r: np.ndarray, p: np.ndarray, rank: np.ndarray) -> None:
            base, node = r * (2 * w), p + w
            flat_t[base + node] = np.where(rank >= NONE, limit, rank * w + p)
            node = node >> 1
            while len(node) and node[0]:
                flat_t[base + node] = np.minimum(flat_t[base + 2 * node], flat_t[base + 2 * node + 1])
                node = node >> 1

        while True:
            best = flat_t[rows * (2 * w) + 1]
            rows, best = rows[best < limit], best[best < limit]
            if not len(rows):
                break
            p, rank = best % w, best // w
            o = rows * w
            q = flat_n[o + p]  # the right part, which dies
            after = flat_n[o + q]
            flat_i[o + p], flat_i[o + q], flat_n[o + p] = rank, -1, after
            has = after < lens[rows]
            flat_p[(o + after)[has]] = p[has]
            right = np.where(has, flat_i[np.where(has, o + after, 0)], -1)
            before = flat_p[o + p]
            led = before >= 0
            update(rows, q, np.full(len(rows), NONE))
            update(rows, p, self.rank(rank, right))
            if led.any():
                b = before[led]
                update(rows[led], b, self.rank(flat_i[o[led] + b], rank[led]))
        keep = ids >= 0
        counts = keep.sum(axis=1)
        flat = ids[keep].tolist()
        ends = np.cumsum(counts).tolist()
        return [flat[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not yet known."""
        new = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(new) > self.keep:
            self.seen = {p: self.seen[p] for p in pieces if p in self.seen}
        raw = [to_bytes(p) for p in new]
        hard = [i for i, b in enumerate(raw) if b not in self.ranks]
        ids: list[list[int]] = [[self.ranks[b]] if b in self.ranks else [] for b in raw]
        for i, x in zip(hard, self.merge([raw[i] for i in hard]), strict=True):
            ids[i] = x
        for p, x in zip(new, ids, strict=True):
            self.seen[p] = (len(x), " ".join(map(str, x)).encode(), self.decode(x))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        pieces = self.pattern.findall(text or "")
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self.seen[p][1].split()]

    def digests(self, texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded bytes) of each text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < chars):
                size += len(texts[end] or "")
                end += 1
            found = [self.pattern.findall(t or "") for t in texts[at:end]]
            self.learn(set().union(*found))
            seen = self.seen
            for pieces in found:
                got = [seen[p] for p in pieces]
                yield (
                    sum(g[0] for g in got),
                    hashlib.sha256(b" ".join([g[1] for g in got])).hexdigest(),
                    hashlib.sha256(b"".join([g[2] for g in got])).hexdigest(),
                )
            at = end


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with a column of ids (array of int) appended, or in place of one of that name."""
    return map_column(docs, text, lambda: loaded(path, pattern).fresh().encode, ids, "array<int>")


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the decoded bytes (binary) appended; null ids decode to nothing."""
    return map_column(docs, ids, lambda: lambda x: loaded(path, pattern).decode(x or []), out, "binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return map_rows(docs, ["doc_id"], ["text"], lambda: loaded(path, pattern).fresh().digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
