"""Exact substring dedup over word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one text. Its minimiser is the least hash of its ``m``-word runs; consecutive windows
of one minimiser are a super-k-mer. Equal windows have equal minimisers, so each window meets its equals in the bucket of
its minimiser. Hashes only say where strings meet; whether windows are equal is decided by their words.

1. One pass over the texts gives a small row for each super-k-mer: minimiser, text, start, number of windows. Minimisers that
   occur once (and hold no window twice) can't hold a repeat and are left out.
2. The super-k-mers of the others travel as one packed string each. Equal strings of one bucket are counted first, combined
   before the shuffle, so copies in any number are one string with a count, and all its windows are repeated.
3. In each bucket the windows of its different strings are sorted and counted, weighted by those counts.
4. A bucket of more than ``hot`` different strings is split by a second minimiser (the greatest hash of the m-word runs): runs
   of windows with one pair of both travel on. Where a pair still has more than ``hot``, its windows go one by one and are
   counted by an aggregation over the strings.
5. What is repeated goes back to the texts as bit masks.

Texts are told apart by a 128-bit digest, whatever their ids; equal texts are one text with a number of copies, packed once.
Minimisers and strings that make up more than a thousandth of the rows are joined by broadcast (see ``join_hot``).

Defined results: a null text has no words; texts shorter than a window lose nothing; repeated rows are copies of one
another; rows with a null or repeated doc_id are texts like all others, and ids may be of any type; windows are judged on the
input; texts of any length are hashed in pieces that overlap by a window; an empty table gives an empty one; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_group, grams, join_hot, map_rows, mix, release, signed, text_key, to_bytes, written

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 500_000  # words hashed together
LONGEST = 512  # windows in a super-k-mer


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class SuperKmers:
    def __init__(self, k: int, m: int, longest: int = LONGEST):
        self.k, self.m, self.longest = k, min(m, k), longest
        self.size = 0

    def _sums(self, h: np.ndarray) -> np.ndarray:
        if len(h) >= self.size:
            self.size = 2 * len(h) + 2
            self.up, self.down = _powers(BASE, self.size), _powers(BASE_INVERSE, self.size)
        return np.r_[np.zeros(1, np.uint64), np.add.accumulate(h * self.up[: len(h)])]

    def extremes(self, h: np.ndarray, pick: np.ufunc = np.minimum) -> np.ndarray:
        """The least (or greatest) hash of the m-word runs of each window."""
        a = mix(grams(h, self.m))
        need, have = self.k - self.m + 1, 1
        while have < need:
            step = min(have, need - have)
            a = pick(a[:-step], a[step:])
            have += step
        return a

    def of(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, windows, minimiser, whether a window may repeat inside) of each super-k-mer.

        h: word hashes of many texts after each other; doc: the text of each word, ascending.
        """
        k = self.k
        at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :]) if len(h) >= k else np.empty(0, np.int64)
        if not len(at):
            e = np.empty(0, np.int64)
            return e, e, e.astype(np.uint64), e.astype(bool)
        mz, d = self.extremes(h)[at], doc[at]
        new = np.r_[True, (mz[1:] != mz[:-1]) | (d[1:] != d[:-1])]
        first = np.flatnonzero(new)
        new[((np.arange(len(at)) - first[np.cumsum(new) - 1]) % self.longest) == 0] = True
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        c = self._sums(h)
        w = mix(mix((c[at + k] - c[at]) * self.down[at]) + run.astype(np.uint64))
        order = np.argsort(w, kind="stable")
        inside = np.zeros(len(first), bool)
        inside[run[order[1:][w[order[1:]] == w[order[:-1]]]]] = True
        return at[first], np.diff(np.r_[first, len(at)]), mz[first], inside


def _occurrences(texts: DataFrame, k: int, m: int, piece: int, longest: int) -> DataFrame:
    """(mz, k1, k2, start, size, inside) of each super-k-mer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, kmers = WordHashes(), SuperKmers(k, m, longest)
        held: list[tuple] = []
        count = 0

        def flush() -> pd.DataFrame:
            h = np.concatenate([x[3] for x in held])
            sizes = [len(x[3]) for x in held]
            doc = np.repeat(np.arange(len(held)), sizes)
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            s, size, mz, inside = kmers.of(h, doc)
            d = doc[s]
            k1, k2, off = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 2))
            return pd.DataFrame({"mz": signed(mz), "k1": k1[d], "k2": k2[d], "start": (s - begin[d] + off[d]).astype(np.int32), "size": size.astype(np.int32), "inside": inside})

        for b in batches:
            for k1, k2, text in zip(b["k1"], b["k2"], b["text"], strict=True):
                words = to_bytes(text).split()
                for a in range(0, len(words) - k + 1, piece):
                    part = hashes.of(words[a : a + piece + k - 1])
                    held.append((k1, k2, a, part))
                    count += len(part)
                    if count >= piece:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    return texts.mapInPandas(run, "mz long, k1 long, k2 long, start int, size int, inside boolean")


def _bits(size: int, hit: list[int]) -> bytes:
    mask = np.zeros(size, np.uint8)
    mask[hit] = 1
    return np.packbits(mask).tobytes()


def _pack(carriers: DataFrame, k: int) -> DataFrame:
    """(mz, k1, k2, start, size, n, c, packed) of each wanted super-k-mer; c is a digest of the packed words."""
    names = ["mz", "k1", "k2", "start", "size", "n", "c", "packed"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for k1, k2, n, text, wanted in zip(b["k1"], b["k2"], b["n"], b["text"], b["kmers"], strict=True):
                words = to_bytes(text).split()
                for x in wanted:
                    s, size = x["start"], x["size"]
                    said = b" ".join(words[s : s + size + k - 1])
                    out.append((x["mz"], k1, k2, s, size, n, hashlib.md5(said, usedforsecurity=False).digest(), said))
                    held += len(said) + 100
                if held > 16_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return carriers.mapInPandas(pack, "mz long, k1 long, k2 long, start int, size int, n long, c binary, packed binary")


def _split(contents: DataFrame, k: int, m: int) -> DataFrame:
    """Strings cut into runs of windows with one second minimiser: adds mx and the run's place, size and string."""
    names = ["mz", "mx", "c", "n", "at", "size", "packed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, kmers = WordHashes(), SuperKmers(k, m)
        for b in batches:
            out = []
            for mz, c, n, packed in zip(b["mz"], b["c"], b["n"], b["packed"], strict=True):
                words = bytes(packed).split(b" ")
                mx = kmers.extremes(hashes.of(words), np.maximum)
                cuts = [0, *(np.flatnonzero(mx[1:] != mx[:-1]) + 1).tolist(), len(mx)]
                out += [(mz, int(signed(mx[a : a + 1])[0]), c, n, a, e - a, b" ".join(words[a : e + k - 1])) for a, e in zip(cuts, cuts[1:], strict=False)]
            yield pd.DataFrame(out, columns=names)

    return contents.mapInPandas(run, "mz long, mx long, c binary, n long, at int, size int, packed binary")


def _singles(contents: DataFrame, k: int) -> DataFrame:
    """(mz, c, n, at, window): the windows of strings one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for mz, c, n, at, packed in zip(b["mz"], b["c"], b["n"], b["at"], b["packed"], strict=True):
                words = bytes(packed).split(b" ")
                each = range(len(words) - k + 1)
                yield pd.DataFrame({"mz": mz, "c": [c] * len(each), "n": n, "at": [at + a for a in each], "window": [b" ".join(words[a : a + k]) for a in each]})

    return contents.mapInPandas(run, "mz long, c binary, n long, at int, window binary")


def _count_windows(k: int):
    """For by_group: sort and count the windows of a bucket's strings; gives masks of the strings that occur once."""

    def count(g: pd.DataFrame) -> dict | None:
        windows = []
        for r, p in enumerate(g["packed"]):
            words = bytes(p).split(b" ")
            windows += [(b" ".join(words[a : a + k]), r, a) for a in range(len(words) - k + 1)]
        windows.sort()
        n = g["n"].tolist()
        hit: dict[int, list[int]] = {}
        a = 0
        while a < len(windows):
            e, total = a, 0
            while e < len(windows) and windows[e][0] == windows[a][0]:
                total += n[windows[e][1]]
                e += 1
            if total > 1:
                for _, r, at in windows[a:e]:
                    hit.setdefault(r, []).append(at)
            a = e
        rows = sorted(r for r in hit if n[r] == 1)
        if not rows:
            return None
        size, c = g["size"].tolist(), g["c"].tolist()
        return {"mz": g["mz"].to_numpy()[rows], "c": [c[r] for r in rows], "at": g["at"].to_numpy()[rows], "size": g["size"].to_numpy()[rows], "mask": [_bits(size[r], hit[r]) for r in rows]}

    return count


MASK = "mz long, c binary, at int, size int, mask binary"


def repeated_words(docs: DataFrame, k: int = 50, m: int = 6, hot: int = 4096, piece: int = PIECE, longest: int = LONGEST) -> DataFrame:
    """(k1, k2, text, masks): each different text, under its digest, with the masks of its repeated windows (null if none)."""
    texts = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    # 1. places; minimisers that occur more than once
    occ = written(_occurrences(texts, k, m, piece, longest))
    total = occ.count()
    shared = written(occ.groupBy("mz").agg(F.count("*").alias("rows"), F.max("inside").alias("self")).where("rows > 1 or self").drop("self"))
    left = join_hot(occ.select("mz", "k1", "k2", "start", "size"), shared, ["mz"], "rows", total)
    kmers = F.collect_set(F.struct("mz", "start", "size"))  # sets of equal texts are combined before the shuffle
    wanted = written(left.groupBy("k1", "k2").agg(kmers.alias("kmers"), F.count("*").alias("rows")).select("k1", "k2", "kmers", (F.col("rows") / F.size("kmers")).cast("long").alias("n")))
    # 2. packed strings, equal ones counted
    one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    packed = written(_pack(one.join(wanted, ["k1", "k2"]), k))
    release(occ, shared, wanted)
    contents = written(packed.groupBy("mz", "c", "packed", "size").agg(F.sum("n").alias("n"), F.count("*").alias("places")))
    places = contents.agg(F.count("*").alias("strings"), F.coalesce(F.sum("places"), F.lit(0)).alias("places")).first()
    # 3. buckets that hold a string that occurs once: in the others all windows are repeated
    kinds = written(contents.groupBy("mz").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1").drop("least"))
    met = join_hot(contents.select("mz", "c", "n", "size", "packed"), kinds, ["mz"], "kinds", places["strings"])
    at0 = ["mz", "c", "n", F.lit(0).alias("at"), "size", "packed"]
    cold = by_group(met.where(F.col("kinds") <= hot).select(*at0), ["mz"], _count_windows(k), MASK)
    # 4. hot buckets by a second minimiser, then by window
    runs = written(_split(met.where(F.col("kinds") > hot).select("mz", "c", "n", "packed"), k, m))
    sizes = written(runs.groupBy("mz", "mx").agg(F.count("*").alias("kinds")))
    parts = join_hot(runs, sizes, ["mz", "mx"], "kinds", runs.count())
    lukewarm = by_group(parts.where(F.col("kinds") <= hot).select("mz", "mx", "c", "n", "at", "size", "packed"), ["mz", "mx"], _count_windows(k), MASK)
    single = _singles(parts.where(F.col("kinds") > hot).select("mz", "c", "n", "at", "packed"), k)
    often = single.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    hits = single.where("n = 1").join(often, "window").select("mz", "c", "at", F.lit(1).alias("size"), F.lit(None).cast("binary").alias("mask"))
    # 5. back to the texts
    whole = contents.where("n > 1").select("mz", "c", F.lit(0).alias("at"), "size", F.lit(None).cast("binary").alias("mask"))
    found = whole.union(cold).union(lukewarm).union(hits).groupBy("mz", "c").agg(F.collect_list(F.struct("at", "size", "mask")).alias("found"))
    marked = written(found.join(contents.select("mz", "c", "places"), ["mz", "c"]))
    back = join_hot(packed.select("mz", "c", "k1", "k2", "start"), marked, ["mz", "c"], "places", places["places"])
    ranges = back.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.transform("found", lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["size"].alias("size"), x["mask"].alias("mask"))))).alias("masks"))
    return one.join(ranges, ["k1", "k2"], "left")


def kept_words(words: list[bytes], masks, k: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if masks is None or not len(masks):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for x in masks:
        s, size = x["start"], x["size"]
        if x["mask"] is None:
            cover[s] += 1
            cover[s + size + k - 1] -= 1
        else:
            at = s + np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8))[:size])
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
    gone = np.cumsum(cover)[: len(words)] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _by_text(docs: DataFrame, results: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and the results of its text for each row; very frequent texts are joined by broadcast."""
    keyed = docs.select("doc_id", *text_key(F.col("text")))
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    small = written(results.join(copies, ["k1", "k2"]))
    total = small.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    return join_hot(keyed, small, ["k1", "k2"], "copies", total).select("doc_id", *names)


def remove_repeats(docs: DataFrame, window: int = 50, out: str = "clean_text", **kw) -> DataFrame:
    """(doc_id, clean_text) of each row: kept words joined by one space."""

    def rows(texts, masks):
        for t, m in zip(texts, masks, strict=True):
            yield (b" ".join(kept_words(to_bytes(t).split(), m, window)).decode("utf-8", "replace"),)

    r = map_rows(repeated_words(docs, window, **kw), ["k1", "k2"], ["text", "masks"], lambda: rows, f"`{out}` string")
    return _by_text(docs, r, [f"`{out}`"])


def digests(docs: DataFrame, window: int = 35, **kw) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""

    def rows(texts, masks):
        for t, m in zip(texts, masks, strict=True):
            words = to_bytes(t).split()
            kept = kept_words(words, m, window)
            yield len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    r = map_rows(repeated_words(docs, window, **kw), ["k1", "k2"], ["text", "masks"], lambda: rows, "n_words long, n_removed long, kept_sha256 string")
    return _by_text(docs, r, ["n_words", "n_removed", "kept_sha256"])
