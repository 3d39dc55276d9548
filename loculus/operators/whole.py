"""Keys that fit a task: all rows of a key in one place, so what is near what is worked out there and nothing is sent twice.

A grid join sends each point to several grid cells, and each close pair on to its count. Where a key has few points, one shuffle by
key is enough: tasks see whole keys in Arrow batches and give out counts. Keys of more than ``LIMIT`` points go by the grid, which
spreads them. Within a key points are sorted by x, and strips of them are compared with what can be near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import store

#: Points of a key that a task may hold; distances of a strip; points that are worked on at once, about.
LIMIT = 50_000
STRIP = 1 << 18
AT_ONCE = 50_000


def stored(points: DataFrame) -> DataFrame:
    return points if hasattr(points, "_stored_path") else store.stored(points)


def parted(points: DataFrame, keys: list[str], limit: int = LIMIT, write: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Points of keys of at most ``limit`` of them, and the others (None if there are none). Null keys take no part.

    The points are written once, for they are read twice. Keys above the limit are fewer than one in ``limit`` points. Without
    ``write`` the keys alone are read for the count, and points are written only if a key is above the limit; so points that lie by
    key already are not sent again.
    """
    points = (stored(points) if write else points).dropna(subset=keys)
    above = lambda p: p.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*keys)
    if not above(points).take(1):
        return points, None
    points = points if write else stored(points)
    large = F.broadcast(store.stored(above(points)))
    return points.join(large, keys, "left_anti"), points.join(large, keys, "left_semi")


def mapped(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, order: list[str] | None = None, sent: bool = False) -> DataFrame:
    """What ``work`` makes of tables of whole keys, given with the first row of each key and the end; rows go by key once, or not at
    all if they have been ``sent`` already."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_keys(batches, keys):
            yield from work(t, cuts).cast(out).to_batches(max_chunksize=AT_ONCE)

    return (rows if sent else rows.repartition(*keys)).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows with the cuts between keys; no key lies in two."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < AT_ONCE:
            continue
        t = pa.Table.from_batches(held)
        cuts = cuts_of(t, keys)
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
            held = t.slice(cuts[-2]).to_batches()
            n = t.num_rows - cuts[-2]
    if held:
        t = pa.Table.from_batches(held)
        yield t, cuts_of(t, keys)


def cuts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys, and the end."""
    new = np.ones(t.num_rows + 1, bool)
    new[1:-1] = False
    for k in keys:
        c = codes(t.column(k))[0]
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values in their order, -1 for null, and the values."""
    d = column.combine_chunks().dictionary_encode() if not pa.types.is_dictionary(column.type) else column.combine_chunks()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    values = d.dictionary.to_pylist()
    order = sorted(range(len(values)), key=lambda i: values[i])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, -1, rank[at]) if len(values) else np.full(len(at), -1), d.dictionary.take(pa.array(order, pa.int64()))


def numbers(t: pa.Table, *columns: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy().astype(float) for c in columns]


def finite(places: list[np.ndarray]) -> np.ndarray:
    return np.isfinite(np.stack(places)).all(axis=0)


def taken(t: pa.Table, columns: list[str], rows: np.ndarray) -> list[pa.ChunkedArray]:
    at = pa.array(rows)
    return [t.column(c).take(at) for c in columns]


def texts(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values by number, null for -1."""
    return values.take(pa.array(np.where(at < 0, 0, at), pa.int64(), mask=at < 0))


def strips(a: list[np.ndarray], b: list[np.ndarray], radius: float, itself: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all a[i], b[j] within the radius, a strip of a at a time; both are sorted by their first coordinate.

    With ``itself`` a and b are one, and each unordered pair is given once.
    """
    n, reach = len(a[0]), radius * radius
    x, y, start = a[0], b[0], 0
    while start < n:
        end = min(n, start + 128)
        while True:
            slack = 1e-9 * (abs(x[start]) + abs(x[end - 1]) + radius)
            lo = start if itself else int(np.searchsorted(y, x[start] - radius - slack))
            hi = int(np.searchsorted(y, x[end - 1] + radius + slack, "right"))
            if end - start == 1 or (end - start) * (hi - lo) <= STRIP:
                break
            end = start + max(1, (end - start) // 2)
        if hi > lo:
            d = np.subtract.outer(a[0][start:end], b[0][lo:hi])
            d *= d
            for p, q in zip(a[1:], b[1:], strict=True):
                e = np.subtract.outer(p[start:end], q[lo:hi])
                e *= e
                d += e
            near = d <= reach
            if itself:
                k = end - start
                near[:, :k] &= np.arange(k)[None, :] > np.arange(k)[:, None]
            at = np.flatnonzero(near)
            i, j = np.divmod(at, hi - lo)
            yield i + start, j + lo
        start = end


def close_pairs(t: pa.Table, cuts: np.ndarray, radius: float, dims: tuple[str, ...], ident: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the key, rows, rows): unordered pairs of rows of a key within the radius that differ in their ident."""
    places, ids = numbers(t, *dims), codes(t.column(ident))[0]
    known = finite(places) & (ids >= 0)
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows = lo + np.flatnonzero(known[lo:hi])
        rows = rows[np.argsort(places[0][rows], kind="stable")]
        own = [p[rows] for p in places]
        for i, j in strips(own, own, radius, True):
            i, j = rows[i], rows[j]
            other = ids[i] != ids[j]
            yield k, i[other], j[other]


def ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lesser and the greater of two numbers; a null (-1) counts for nothing, as in SQL."""
    return np.where(a < 0, b, np.where(b < 0, a, np.minimum(a, b))), np.maximum(a, b)


def gene_pairs(rows: DataFrame, keys: list[str], radius: float, dims: tuple[str, ...] = ("x", "y"), ident: str = "tx_id", sums: tuple[str, ...] = ()) -> DataFrame:
    """(keys, g1, g2, obs, <sums>, n1, n2, total, close): close pairs of whole keys by gene, the sums of their means of columns,
    points of both genes, all points and all close pairs of the key."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "g1", "g2", "obs", *sums, "n1", "n2", "total", "close"]
    schema = f"{kinds}, g1 string, g2 string, obs long, {''.join(f'`{s}` double, ' for s in sums)}n1 long, n2 long, total long, close long"

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        gene, values = codes(t.column("gene"))
        wide = len(values) + 1
        weights = numbers(t, *sums)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k, i, j in close_pairs(t, cuts, radius, dims, ident):
            lo, hi = ordered(gene[i], gene[j])
            pair, inverse = np.unique((lo + 1) * wide + hi + 1, return_inverse=True)
            found.setdefault(k, []).append((pair, np.bincount(inverse, minlength=len(pair)), *[np.bincount(inverse, (w[i] + w[j]) / 2, minlength=len(pair)) for w in weights]))
        out = []
        for k, parts in found.items():
            pair, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            if not len(pair):
                continue
            added = [np.bincount(inverse, np.concatenate([p[c] for p in parts]), minlength=len(pair)) for c in range(1, len(sums) + 2)]
            g = np.bincount(gene[cuts[k] : cuts[k + 1]] + 1, minlength=wide)
            lo, hi = np.divmod(pair, wide)
            n = len(pair)
            out.append((np.full(n, cuts[k]), lo - 1, hi - 1, *added, g[lo], g[hi], np.full(n, cuts[k + 1] - cuts[k]), np.full(n, int(added[0].sum()))))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * (len(names) - len(keys) + 1)
        of = lambda v, s: pa.array(v.astype(float if s else np.int64))
        return pa.table([*taken(t, keys, c[0].astype(np.int64)), texts(values, c[1]), texts(values, c[2]), *[of(v, name in sums) for name, v in zip(names[len(keys) + 2 :], c[3:], strict=True)]], names=names)

    return mapped(rows.select(*dict.fromkeys([*keys, ident, "gene", *dims, *sums])), keys, work, schema)


def near_genes(rows: DataFrame, keys: list[str], ids: list[str], radius: float, kind: str) -> DataFrame:
    """(ids, gene, n, total, own, size): for samples of whole keys, the points of each gene within the radius and of all; and of the
    sample's key the points of the gene and of all, with a row for each gene of the key. Samples near nothing have no rows.

    ``kind``: 0 for a point, 1 for a sample, 2 for what is both.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in ids)

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        gene, values = codes(t.column("gene"))
        places, role = numbers(t, "x", "y"), t.column(kind).to_numpy()
        known = finite(places)
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = lo + np.flatnonzero(known[lo:hi])
            at = at[np.argsort(places[0][at], kind="stable")]
            s, p = at[role[at] > 0], at[role[at] != 1]
            if not len(s) or not len(p):
                continue
            mine = lo + np.flatnonzero(role[lo:hi] != 1)
            there, local = np.unique(gene[mine], return_inverse=True)
            of = np.empty(hi - lo, np.int64)
            of[mine - lo] = local
            own, wide, of = np.bincount(local), len(there), of[p - lo]
            for i, j in strips([c[s] for c in places], [c[p] for c in places], radius):
                if not len(i):
                    continue
                first = i[0]
                n = np.bincount((i - first) * wide + of[j], minlength=(i[-1] - first + 1) * wide).reshape(-1, wide)
                total = n.sum(axis=1)
                some = np.flatnonzero(total)
                n, total = n[some], total[some]
                out.append((np.repeat(s[some + first], wide), np.tile(there, len(some)), n.ravel(), np.repeat(total, wide), np.tile(own, len(some)), np.full(n.size, len(mine))))
        c = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table([*taken(t, ids, c[0]), texts(values, c[1]), *map(pa.array, c[2:])], names=[*ids, "gene", "n", "total", "own", "size"])

    return mapped(rows.select(*dict.fromkeys([*keys, *ids, "gene", "x", "y", kind])), keys, work, f"{kinds}, gene string, n long, total long, own long, size long")


def sliced_pairs(rows: DataFrame, radius: float, least: int) -> DataFrame:
    """(cell, g1, g2, obs, trials, p0) of whole cells: close pairs within their z slices of more than ``least`` points, the sums of
    products of both genes' counts over these slices, and the share of close pairs, a slice without any counting as full."""
    names = ["cell", "g1", "g2", "obs", "trials", "p0"]

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        gene, values = codes(t.column("gene"))
        wide = len(values) + 1
        slices = cuts_of(t, ["cell", "z"])
        met: dict[int, list[np.ndarray]] = {}
        for k, i, j in close_pairs(t, slices, radius, ("x", "y"), "tx_id"):
            lo, hi = ordered(gene[i], gene[j])
            met.setdefault(k, []).append((lo + 1) * wide + hi + 1)
        out = []
        first = np.searchsorted(slices, cuts)
        for a, b, row in zip(first[:-1], first[1:], cuts[:-1], strict=True):
            used = [k for k in range(a, b) if slices[k + 1] - slices[k] > least]
            found = [np.concatenate(met[k]) if k in met else np.zeros(0, np.int64) for k in used]
            if not sum(map(len, found)):
                continue
            pair, obs = np.unique(np.concatenate(found), return_counts=True)
            lo, hi = np.divmod(pair, wide)
            trials, close, pairs = np.zeros(len(pair), np.int64), 0.0, 0.0
            for k, f in zip(used, found, strict=True):
                g, n = np.bincount(gene[slices[k] : slices[k + 1]] + 1, minlength=wide), int(slices[k + 1] - slices[k])
                trials += g[lo] * g[hi]
                close += len(f) if len(f) else n * (n - 1) / 2
                pairs += n * (n - 1) / 2
            named = (lo > 0) & (hi > 0)
            out.append((np.full(named.sum(), row), lo[named] - 1, hi[named] - 1, obs[named], trials[named], np.full(named.sum(), close / pairs)))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table([*taken(t, ["cell"], c[0].astype(np.int64)), texts(values, c[1]), texts(values, c[2]), *map(pa.array, (c[3], c[4], c[5].astype(float)))], names=names)

    rows = rows.select("cell", "z", "tx_id", "gene", "x", "y").dropna(subset=["z"])
    return mapped(rows, ["cell"], work, f"cell {rows.schema['cell'].dataType.simpleString()}, g1 string, g2 string, obs long, trials long, p0 double", ["z"])


def nearest(rows: DataFrame, k: int, keys: list[str], ident: str) -> DataFrame:
    """(keys, ident, rank, neighbour, d2) of whole keys: the k nearest rows with an ``_other`` of each row without, ties by it."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, ident])

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        place, right = numbers(t, "x", "y"), t.column("_right").to_numpy()
        other = codes(t.column("_other"))[0]
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = lo + np.flatnonzero(~right[lo:hi]), lo + np.flatnonzero(right[lo:hi])
            b = b[np.argsort(other[b], kind="stable")]
            most = min(k, len(b))
            if not most:
                continue
            size = max(1, STRIP // len(b))
            for s in range(0, len(a), size):
                mine = a[s : s + size]
                dx, dy = np.subtract.outer(place[0][mine], place[0][b]), np.subtract.outer(place[1][mine], place[1][b])
                d = dx * dx + dy * dy
                c = np.where(np.isnan(d), np.inf, d)
                i, j = np.nonzero(c <= np.partition(c, most - 1, axis=1)[:, most - 1 : most])
                order = np.lexsort((j, c[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                i, j, rank = i[rank <= most], j[rank <= most], rank[rank <= most]
                out.append((mine[i], rank, b[j], d[i, j]))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([*taken(t, [*keys, ident], c[0]), pa.array(c[1], pa.int32()), *taken(t, ["_other"], c[2]), pa.array(c[3].astype(float))], names=[*keys, ident, "rank", "neighbour", "d2"])

    return mapped(rows, keys, work, f"{kinds}, rank int, neighbour {rows.schema['_other'].dataType.simpleString()}, d2 double")
