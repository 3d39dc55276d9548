"""Packing of documents into sequences of a fixed capacity: cutting stock by column generation over the histogram of lengths.

Whole multiples of the capacity are cut off a document and fill sequences of their own; what is left is one item. The histogram of
item lengths (fewer entries than the capacity, however many documents there are) goes to the driver. There a linear program
chooses how often each pattern of lengths is used: a revised simplex, begun with the patterns of a largest-first fill, whose
columns are priced by a knapsack dynamic program over the capacity. Its cost is what the sequences take after padding; a sequence
whose length is a power of two needs none. The solution is rounded down, the rest is packed best-fit, and the few sequences that
are still filled badly are cut into full ones, the last of them at powers of two. So every item has its place: documents of one
length are ranked, and the rank says which copy of which pattern.

Defined results: a null or empty text is the closing id alone; texts are read whole; repeated rows, whatever their ids, are
documents of their own, told apart by a row number that is stored with their ids; null doc_ids are kept. An empty table gives an
empty one. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ddl, portions, trimmed, written

#: Documents of one length that are ranked in one task, about.
RANKED = 100_000
#: The linear program ends when its cost is within this share of a lower bound, or after STEPS pivots; any state is a valid plan.
GAP, STEPS = 5e-4, 400
_ENCODERS: dict = {}


def encoder(path: str, pattern: str, special: dict[str, int]):
    """The vocabulary's encoder; strings of special tokens in a text become their ids, as in the tokenizer's own file."""
    import tiktoken

    key = (path, pattern, *special.items())
    if key not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[key]


def padded(length: int, capacity: int) -> int:
    return length if length & (length - 1) == 0 else capacity


def _priced(widths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of exact fills of each length 0..capacity, and the last item of each."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    fits = np.searchsorted(widths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if k := fits[c]:
            got = best[c - widths[:k]] + value[:k]
            i = int(got.argmax())
            best[c], last[c] = got[i], i
    return best, last


def _filled(widths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Largest-first patterns with real multiplicities; each uses up one length at least."""
    rest, out = demand.astype(np.float64), []
    alive = list(range(len(widths)))
    while alive:
        pattern: dict[int, int] = {}
        room, top = capacity, len(alive)
        while top:
            top = bisect_left(alive, room + 1, 0, top, key=lambda i: widths[i])
            if not top:
                break
            i = alive[top - 1]
            n = int(min(room // widths[i], max(1, np.ceil(rest[i]))))
            pattern[i] = n
            room -= n * int(widths[i])
            top -= 1
        times = min(rest[i] / n for i, n in pattern.items())
        for i, n in pattern.items():
            rest[i] -= times * n
        alive = [i for i in alive if i not in pattern or rest[i] > 1e-9]
        out.append((pattern, times))
    return out


def _inverse(columns: list[dict[int, int]], diagonal: list[int]) -> np.ndarray:
    """Inverse of the columns, whose entries above ``diagonal`` (the row of each) are zero in this order. No BLAS: its threads
    hang in a driver that has started its JVM."""
    m = len(columns)
    rows: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for j, p in enumerate(columns):
        for i, n in p.items():
            rows[i].append((j, n))
    out = np.zeros((m, m))
    for j, i in enumerate(diagonal):
        out[j, i] = 1.0
        for k, n in rows[i]:
            if k < j:
                out[j] -= n * out[k]
        out[j] /= columns[j][i]
    return out


def solve(widths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns {index of length: count} and how often each is used, as the linear program says."""
    m = len(widths)
    cost_of = lambda p: padded(sum(int(widths[i]) * n for i, n in p.items()), capacity) + 1.0  # noqa: E731  one more for each sequence
    begun = _filled(widths, demand, capacity)
    # one column for each length that a pattern used up; the others get a column of their own, at level 0
    rows: set[int] = set()
    rest, own = demand.astype(np.float64), []
    for p, t in begun:
        for i, n in p.items():
            rest[i] -= t * n
        gone = [i for i in p if rest[i] <= 1e-9 and i not in rows]
        own.append(gone[0] if gone else None)
        rows.update(gone[:1])
    kept = [j for j, g in enumerate(own) if g is not None]
    columns, diagonal = [begun[j][0] for j in kept], [own[j] for j in kept]
    for i in sorted(set(range(m)) - rows):
        columns.append({i: capacity // int(widths[i])})
        diagonal.append(i)
    inverse = _inverse(columns, diagonal)
    x = np.maximum((inverse * demand).sum(1), 0)
    cost = np.array([cost_of(p) for p in columns])
    total = float((widths * demand).sum()) * (1 + 1 / capacity)  # no sequence costs less than its length and one
    powers = {1 << k for k in range(capacity.bit_length())}
    for _ in range(STEPS):
        y = (cost[:, None] * inverse).sum(0)
        best, last = _priced(widths, y, capacity)
        price = np.full(capacity + 1, capacity + 1.0)
        for c in powers:
            if c <= capacity:
                price[c] = c + 1.0
        at = int((best[1:] - price[1:]).argmax()) + 1
        now = float((cost * x).sum())
        ratio = float((best[1:] / price[1:]).max())
        if best[at] - price[at] <= 1e-7 * price[at] or now <= (1 + GAP) * max(total, float((y * demand).sum()) / max(ratio, 1.0)):
            break
        entering: dict[int, int] = defaultdict(int)
        c = at
        while c:
            entering[int(last[c])] += 1
            c -= int(widths[last[c]])
        d = sum(n * inverse[:, i] for i, n in entering.items())
        able = np.flatnonzero(d > 1e-7)
        if not len(able):
            break
        limits = x[able] / d[able]
        tied = able[limits <= limits.min() + 1e-9]
        j = int(tied[d[tied].argmax()])  # of equal limits the largest pivot, for the inverse's sake
        theta = x[j] / d[j]
        x = np.maximum(x - theta * d, 0)
        x[j] = theta
        pivot = inverse[j] / d[j]
        inverse -= d[:, None] * pivot
        inverse[j] = pivot
        columns[j], cost[j] = dict(entering), price[at]
    return [(p, float(t)) for p, t in zip(columns, x, strict=True) if t > 0]


class Plan:
    """Where the items of each length go. ``pieces`` answers for an item by its length and rank."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        #: By length: first ranks of runs, and the runs: (first sequence, items of the length in a sequence, place of the first).
        self.starts: dict[int, list[int]] = defaultdict(list)
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        #: By length: rank of the first item placed singly, and the pieces of each: (sequence, place, from, length).
        self.single_from: dict[int, int] = {}
        self.singles: dict[int, list[list[tuple[int, int, int, int]]]] = defaultdict(list)
        widths = np.array(sorted(w for w, n in histogram.items() if n and w), np.int64)
        rest = np.array([histogram[int(w)] for w in widths], np.int64)
        given = np.zeros(len(widths), np.int64)
        for p, t in sorted(solve(widths, rest, capacity), key=lambda q: -q[1]) if len(widths) else ():
            n = min(int(t + 1e-6), *(int(rest[i]) // k for i, k in p.items()))
            if not n:
                continue
            place = 0
            for i, k in sorted(p.items()):
                w = int(widths[i])
                self.starts[w].append(int(given[i]))
                self.runs[w].append((self.sequences, k, place))
                place += k * w
                given[i] += n * k
                rest[i] -= n * k
            self.sequences += n
        self.single_from = {int(w): int(g) for w, g in zip(widths, given, strict=True)}
        self._rest([int(w) for w, n in zip(widths[::-1], rest[::-1], strict=True) for _ in range(n)])

    def _rest(self, items: list[int]) -> None:
        """Best fit, largest first; what is filled badly is laid end to end and cut."""
        bins: list[list[int]] = []
        room: list[tuple[int, int]] = []
        for w in items:
            at = bisect_left(room, (w, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = self.capacity, len(bins)
                bins.append([])
            bins[b].append(w)
            if free > w:
                insort(room, (free - w, b))
        loose: list[int] = []
        for b in bins:
            if padded(n := sum(b), self.capacity) - n > self.capacity // 64:
                loose += b
                continue
            place = 0
            for w in b:
                self.singles[w].append([(self.sequences, place, 0, w)])
                place += w
            self.sequences += 1
        left = sum(loose)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << k for k in range(self.capacity.bit_length(), -1, -1) if left % self.capacity >> k & 1]
        place, at = 0, 0
        for w in loose:
            pieces, done = [], 0
            while done < w:
                n = min(w - done, sizes[at] - place)
                pieces.append((self.sequences, place, done, n))
                done, place = done + n, place + n
                if place == sizes[at]:
                    at, place, self.sequences = at + 1, 0, self.sequences + 1
            self.singles[w].append(pieces)

    def pieces(self, width: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(sequence, place in it, first id of the item, ids) of each piece."""
        if rank >= (first := self.single_from[width]):
            return self.singles[width][rank - first]
        r = bisect_left(self.starts[width], rank + 1) - 1
        sequence, n, place = self.runs[width][r]
        copy, slot = divmod(rank - self.starts[width][r], n)
        return [(sequence + copy, place + slot * width, 0, width)]


def tokenized(docs: DataFrame, path: str, pattern: str, special: dict[str, int], end: int) -> DataFrame:
    """doc_id, ids as little-endian 32-bit numbers (the closing id included), their number n."""
    schema = f"{ddl(docs, ['doc_id'])}, ids binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, special)
        allowed = set(special)
        for b in portions(batches, 500):
            ids = [np.array([*enc.encode(t or "", allowed_special=allowed, disallowed_special=()), end], "<u4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())], names=["doc_id", "ids", "n"])
        trimmed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, pattern: str, special: dict[str, int], end: int, capacity: int) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = written(tokenized(docs, path, pattern, special, end).withColumn("row", F.monotonically_increasing_id()))
    sized = tokens.withColumn("w", (F.col("n") % capacity).cast("int"))
    histogram = {r.w: r["count"] for r in sized.groupBy("w").count().collect()}  # fewer rows than the capacity
    buckets = max(1, -(-sum(histogram.values()) // RANKED))
    plan = Plan(histogram, capacity)
    fields = f"{ddl(docs, ['doc_id'])}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    full = F.floor(F.col("n") / capacity)
    keys = ["w", "bucket"]
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("c"), F.sum(full).alias("f"))
    offsets = counts.select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    inside = Window.partitionBy(*keys).orderBy("row")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).withColumn("f", F.coalesce(F.sum(full).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(offsets, keys).select("doc_id", "ids", "n", "w", (F.col("r") + F.col("c0")).alias("rank"), (F.col("f") + F.col("f0")).cast("long").alias("full"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 500):
            rows = []
            for k, (ids, n, w, rank, before_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ids", "n", "w", "rank", "full")), strict=True)):
                whole = n // capacity
                # sequences of one document each: numbered within the documents of equal rest, so that no count over all is needed
                cut = [(plan.sequences + (before_ + i) * capacity + w, 0, i * capacity, capacity) for i in range(whole)]
                if w:
                    cut += [(s, place, whole * capacity + at, m) for s, place, at, m in plan.pieces(w, rank)]
                rows += [(k, at, m, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + m)]), n, s, place) for s, place, at, m in cut]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
        trimmed()

    return placed.mapInArrow(emit, fields)
