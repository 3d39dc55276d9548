"""Hard negatives by exact inner products, found through one-dimensional distance keys.

Vectors are made of whole numbers. Each gets one more component, sqrt(M - |x|^2) with M the largest squared length, so that a
larger inner product with a query is a smaller distance to it. Every vector is stored under the key (nearest pivot, distance to
it), sorted; the sorted keys are cut into segments of one pivot each. A search visits the segments in the order of the distance
that they can't fall below, |d(q, pivot) - d(x, pivot)|, in rounds of growing width, and reads of each only the key interval that
may still hold a result. It ends when that bound excludes all that is left, so the result is that of an exhaustive search.

Rows of equal label and vector have equal scores with everything. They are one entry of the index, with as many of their least
ids as a result can name; each of them that is an anchor has its own results. Only pivots depend on a sample.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part, nor as anchors. A row that
repeats another one exactly counts once; rows that share an id but differ are separate rows of that id, and neither is an
"other" row of the other. Vectors of unequal length are filled up with zeros; an empty one scores 0 with all. Ties go to the
smaller id. An empty table gives an empty one. Columns beyond the three named ones are ignored. Scores that don't fit into 64
bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, trimmed, written

#: Rows of the sample that pivots are fitted on, at most (and as many as fit into SAMPLE_BYTES); every row is indexed.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
PIVOTS = 32
#: Bytes of vectors in a segment, about; rows of a packed block; queries that meet a segment in one task.
SEGMENT_BYTES, BLOCK, QUERIES = 32 << 20, 1024, 100_000
#: Shares of the index within reach in each round; the last one reaches everything that the bound leaves.
REACH = (1 / 16, 1 / 4, 1.0)
LEAST, MOST = -(2**63), 2**63 - 1


def _packed(rows: np.ndarray) -> bytes:
    """int64 components as bytes, two each if all fit, else eight."""
    return rows.astype("<i2").tobytes() if not rows.size or max(rows.max(), -rows.min()) < 2**15 else rows.astype("<i8").tobytes()


def _rows(parts: list[bytes], counts: list[int], dim: int) -> np.ndarray:
    """A matrix of the packed rows, filled up with zeros to ``dim`` columns."""
    out = np.zeros((sum(counts), dim), np.int64)
    at = 0
    for b, n in zip(parts, counts, strict=True):
        wide = b[:1] == b"\x08"
        v = np.frombuffer(b, "<i8" if wide else "<i2", offset=1)
        if v.size:
            v = v.reshape(n, -1)
            out[at : at + n, : v.shape[1]] = v
        at += n
    return out


def _marked(rows: np.ndarray) -> bytes:
    b = _packed(rows)
    return (b"\x08" if rows.size and len(b) == 8 * rows.size else b"\x02") + b


def whole_vectors(df: DataFrame, scale: float, keep: int | None, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, the key (k1, k2) of (label, vector), a 64-bit hash of the label, components floor(scale * x) packed, squared length.

    Of each batch's rows of equal key only the ``keep`` least ids go on (None: all), as a combiner would do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[int, int], list] = {}
            every = []
            for i, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x = x.values if x.is_valid else None
                if i is None or y is None or x is None or x.null_count:
                    continue
                v = np.asarray(x, np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(scale * v)
                if v.size and np.abs(v).max() >= 2.0**62:
                    raise OverflowError("components of this size have no 64-bit score")
                v = v.astype(np.int64)
                p, h = _marked(v), xxhash.xxh3_64_intdigest(str(y).encode())
                d = np.frombuffer(xxhash.xxh3_128_digest(p + h.to_bytes(8, "little")), np.int64)
                key = (int(d[0]), int(d[1]))
                row = (i, *key, h - 2**64 if h >= 2**63 else h, p, float((v.astype(np.float64) ** 2).sum()), len(v))
                every.append(row) if keep is None else out.setdefault(key, []).append(row)
            for rows in out.values():
                every += list({r[0]: r for r in sorted(rows, key=lambda r: r[0])}.values())[:keep]
            cols = list(zip(*every, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["vec_id", "k1", "k2", "l64", "v", "n2", "dim"])

    cols = [F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.col(label).alias("y")]
    return df.select(*cols).mapInArrow(run, "vec_id long, k1 long, k2 long, l64 long, v binary, n2 double, dim int")


class Space:
    """What all tasks know: dimension, largest squared length, pivots and the directory of segments (one line each)."""

    def __init__(self, dim: int, most: float, rows: int):
        self.dim, self.most, self.rows = dim, most, rows
        self.pivots = np.zeros((1, dim + 1))
        self.seg_pivot = self.lo = self.hi = self.count = np.zeros(0)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))

    def fit(self, sample: np.ndarray, pivots: int, steps: int = 5) -> None:
        """Far-apart rows of the sample, moved to the means of those next to them a few times."""
        # no matrix products here: BLAS threads hang in a driver that has started its JVM
        x = np.unique(self.lifted(sample), axis=0)
        at, near = [0], np.full(len(x), np.inf)
        while len(at) < min(pivots, len(x)):
            near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
            at.append(int(near.argmax()))
        self.pivots = x[at]
        for _ in range(steps):
            own = np.array([((x - p) ** 2).sum(1) for p in self.pivots]).argmin(0)
            self.pivots = np.array([x[own == i].mean(0) if (own == i).any() else p for i, p in enumerate(self.pivots)])

    def slack(self, q2: np.ndarray) -> np.ndarray:
        return 1e-6 + 1e-9 * (q2 + self.most)

    def best_scores(self, q2: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Scores that rows at ``gap`` or farther from a query can't exceed."""
        return (q2 + self.most - gap * gap) / 2 + self.slack(q2)


def segments(classes: DataFrame, space: Space, parallel: int) -> DataFrame:
    """The sorted index: blocks of rows under (segment, pivot); fills in the directory of ``space``."""
    spark = classes.sparkSession
    bound = space

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column("v").to_pylist(), [1] * b.num_rows, bound.dim)
            d = bound.to_pivots(bound.lifted(v)) if len(v) else np.zeros((0, 1))
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own]), *b.columns], names=["pivot", "dist", *b.schema.names])

    fields = "k1 long, k2 long, l64 long, v binary, ids array<long>"
    n = max(parallel, -(-space.rows * max(1, space.dim) * 2 // SEGMENT_BYTES))
    sorted_rows = classes.mapInArrow(keyed, f"pivot int, dist double, {fields}").repartitionByRange(n, "pivot", "dist", "k1", "k2").sortWithinPartitions("pivot", "dist", "k1", "k2")

    def block(rows: list[dict]) -> dict:
        v = _rows([r["v"] for r in rows], [1] * len(rows), bound.dim)
        i8 = lambda xs: np.array(xs, "<i8").tobytes()
        return {
            "pivot": rows[0]["pivot"], "lo": rows[0]["dist"], "hi": rows[-1]["dist"], "n": len(rows), "v": _marked(v), "l64": i8([r["l64"] for r in rows]),
            "dist": np.array([r["dist"] for r in rows]).tobytes(), "ids": i8([x for r in rows for x in r["ids"]]), "counts": i8([len(r["ids"]) for r in rows]),
        }

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[dict] = []

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block(rows) | {"part": part}], schema=kinds)

        for b in batches:
            for r in b.to_pylist():
                if held and (r["pivot"] != held[0]["pivot"] or len(held) == BLOCK):
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)
        trimmed()

    kinds = pa.schema([("part", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("v", pa.binary()), ("l64", pa.binary()), ("dist", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
    blocks = written(sorted_rows.mapInArrow(pack, "part int, pivot int, lo double, hi double, n int, v binary, l64 binary, dist binary, ids binary, counts binary"))
    lines = blocks.groupBy("part", "pivot").agg(F.min("lo"), F.max("hi"), F.sum("n")).orderBy("part", "pivot").collect()
    space.seg_pivot = np.array([r[1] for r in lines], np.int64)
    space.lo, space.hi, space.count = (np.array([r[i] for r in lines], np.float64) for i in (2, 3, 4))
    number = spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(lines)], "part int, pivot int, seg int")
    return blocks.join(F.broadcast(number), ["part", "pivot"])


def _select(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k of (score, id) by descending score and id, of entries with their sorted ids."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        scores, starts, counts = scores[keep], starts[keep], counts[keep]
    rows = [(-int(s), int(i)) for s, a, n in zip(scores, starts, counts, strict=True) for i in ids[a : a + min(n, k)]]
    return [(-s, i) for s, i in sorted(set(rows))[:k]]


def search(index: DataFrame, queries: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """For each query (k1, k2, r, v, l64, lo, hi) the first k rows with lo <= score <= hi whose label is (not) the query's.

    Gives k1, k2, r and ``top``, an array of (score, id) in order; queries without a result have no row.
    """
    n_queries = queries.count()
    parts = max(1, -(-n_queries // QUERIES))
    bound = space
    names = ["seg", "part", "kind", "k1", "k2", "r", "lo", "hi", "kth", "own", "n", "v", "l64", "dist", "ids", "counts"]
    schema = "seg int, part int, kind int, k1 long, k2 long, r long, lo long, hi long, kth long, own long, n int, v binary, l64 binary, dist binary, ids binary, counts binary"
    none = lambda kind: F.lit(None).cast(kind)
    base = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        "seg", "part", F.lit(0).alias("kind"), *[none("long").alias(c) for c in ("k1", "k2", "r", "lo", "hi", "kth", "own")], "n", "v", "l64", "dist", "ids", "counts"
    )

    def routed(last: float, reach: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    q = _rows(b.column("v").to_pylist(), [1] * b.num_rows, bound.dim).astype(np.float64)
                    q2 = (q * q).sum(1)[:, None]
                    d = bound.to_pivots(np.hstack([q, np.zeros((len(q), 1))]))[:, bound.seg_pivot]
                    gap = np.maximum(0, np.maximum(bound.lo - d, d - bound.hi))
                    order = gap.argsort(1, kind="stable")
                    before = np.empty_like(gap)
                    np.put_along_axis(before, order, bound.count[order].cumsum(1) - bound.count[order], 1)
                    within = (before < reach * bound.count.sum()) & ~(before < last * bound.count.sum())
                    best = bound.best_scores(q2, gap)
                    worst = (q2 + bound.most - (d + bound.hi) ** 2) / 2 - bound.slack(q2)
                    num = lambda c: np.array(b.column(c).to_pylist(), np.float64)[:, None]  # noqa: E731, B023
                    i, s = np.nonzero(within & (best >= np.maximum(num("kth"), num("lo"))) & (worst <= num("hi")))
                    t = b.take(pa.array(i))
                    m = len(i)
                    part = np.array([x % parts for x in t.column("k1").to_pylist()], np.int32)
                    empty = pa.nulls(m, pa.binary())
                    cols = [pa.array(s, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(m), pa.int32()), *[t.column(c) for c in ("k1", "k2", "r", "lo", "hi", "kth", "own")], pa.array(np.ones(m), pa.int32()), t.column("v"), empty, empty, empty, empty]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, blocks, entry = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                t = whole.slice(at, 256)
                heads = np.array([t.column(c).to_pylist() for c in ("seg", "part", "kind")]).T
                cuts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1), len(heads)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    seg, part, kind = map(int, heads[a])
                    if (seg, part) != unit:
                        unit, blocks, entry = (seg, part), [], None
                    rows = t.slice(a, z - a)
                    if kind == 0:
                        blocks += rows.select(["n", "v", "l64", "dist", "ids", "counts"]).to_pylist()
                    elif blocks or entry:
                        if entry is None:
                            flat = lambda c, kind="<i8": np.frombuffer(b"".join(x[c] for x in blocks), kind)  # noqa: E731, B023
                            counts = flat("counts")
                            entry = (_rows([x["v"] for x in blocks], [x["n"] for x in blocks], bound.dim), flat("l64"), flat("dist", "<f8"), flat("ids"), counts.cumsum() - counts, counts)
                            order = entry[2].argsort(kind="stable")
                            entry = (*(e[order] for e in entry[:3]), entry[3], entry[4][order], entry[5][order])
                            blocks = []
                        yield _found(rows, seg, entry)
        trimmed()

    def _found(rows: pa.RecordBatch, seg: int, entry: tuple) -> pa.RecordBatch:
        v, labels, dist, ids, starts, counts = entry
        r = {c: rows.column(c).to_pylist() for c in ("k1", "k2", "r", "lo", "hi", "kth")}
        own = np.array(rows.column("own").to_pylist(), np.int64)
        keys, which = np.unique(np.array([r["k1"], r["k2"]], np.int64).T, axis=0, return_index=True, return_inverse=True)[1:]
        which = which.ravel()
        q = _rows([rows.column("v")[int(i)].as_py() for i in keys], [1] * len(keys), bound.dim)
        qf = q.astype(np.float64)
        q2 = (qf * qf).sum(1)
        d = bound.to_pivots(np.hstack([qf, np.zeros((len(q), 1))]))[:, int(bound.seg_pivot[seg])]
        need = np.maximum(np.array(r["kth"], np.float64), np.array(r["lo"], np.float64))
        reach = np.sqrt(np.maximum(q2[which] + bound.most - 2 * (need - bound.slack(q2[which])), 0))  # no farther row reaches the score
        a = np.searchsorted(dist, d[which] - reach - 1e-6 * (1 + reach), "left")
        z = np.searchsorted(dist, d[which] + reach + 1e-6 * (1 + reach), "right")
        first, last = (int(a.min()), int(z.max())) if len(a) else (0, 0)
        part = v[first:last]
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(part).max(initial=0)) * max(1, bound.dim)
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object
        made = []
        for at in range(0, len(q), 64):
            scores = q[at : at + 64].astype(kind) @ part.T.astype(kind)
            for i in np.flatnonzero((which >= at) & (which < at + 64)):
                s = scores[which[i] - at, a[i] - first : z[i] - first]
                lab = labels[a[i] : z[i]]
                hits = np.flatnonzero(((lab == own[i]) == same) & (s >= max(r["lo"][i], r["kth"][i])) & (s <= r["hi"][i]))
                if len(hits):
                    at_hits = hits + a[i]
                    made += [(r["k1"][i], r["k2"][i], r["r"][i], s_, id_) for s_, id_ in _select(s[hits], ids, starts[at_hits], counts[at_hits], k)]
        cols = list(zip(*made, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "r", "s", "id"])

    best, last = None, 0.0
    for reach in REACH:
        asked = queries.withColumnRenamed("l64", "own")
        if best is None:
            asked = asked.withColumn("kth", F.lit(LEAST))
        else:
            known = best.select("k1", "k2", "r", F.when(F.size("top") == k, F.element_at("top", k)["s"]).otherwise(LEAST).alias("kth"))
            asked = asked.join(known, ["k1", "k2", "r"], "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
        asked = asked.select("k1", "k2", "r", "lo", "hi", "kth", "own", "v").mapInArrow(routed(last, reach), schema)
        found = base.unionByName(asked).repartition("seg", "part").sortWithinPartitions("seg", "part", "kind").mapInArrow(scan, "k1 long, k2 long, r long, s long, id long")
        if best is not None:
            found = best.select("k1", "k2", "r", F.explode("top").alias("t")).select("k1", "k2", "r", "t.s", "t.id").unionByName(found)
        order = F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), F.col("id"))))
        top = F.transform(F.slice(order, 1, k), lambda t: F.struct((-t["d"]).alias("s"), t["id"].alias("id")))
        merged = written(found.groupBy("k1", "k2", "r").agg(top.alias("top")))
        if best is not None:
            release(best)
        best, last = merged, reach
    return best


def mine(df: DataFrame, anchors: Column, scale: float, positives: int, negatives: int, low: int, high: int, pivots: int = PIVOTS) -> DataFrame:
    """For each row of ``anchors`` and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    df has vec_id, embedding and label; gives anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    keep = max(positives + 1, negatives)
    every = whole_vectors(df, scale, keep)
    n, most, dim = every.agg(F.count("*"), F.max("n2"), F.max("dim")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    space = Space(int(dim), float(most), int(n))
    wanted = min(SAMPLE, SAMPLE_BYTES // (2 * max(1, space.dim)))
    sample = every.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * wanted / n) * (1 << 20)) + 1)).select("v").limit(wanted).collect()
    space.fit(_rows([r.v for r in sample], [1] * len(sample), space.dim), pivots)
    in_class = Window.partitionBy("k1", "k2").orderBy("vec_id")
    least = every.withColumn("at", F.dense_rank().over(in_class)).where(F.col("at") <= keep)
    classes = least.groupBy("k1", "k2").agg(F.first("l64").alias("l64"), F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    index = segments(classes, space, 2 * spark.sparkContext.defaultParallelism)

    asking = written(whole_vectors(df.where(anchors), scale, None).dropDuplicates(["vec_id", "k1", "k2"]).select("vec_id", "k1", "k2", "l64", "v"))
    heads = asking.groupBy("k1", "k2").agg(F.first("l64").alias("l64"), F.first("v").alias("v"))
    near = search(index, heads.select("*", F.lit(0).cast("long").alias("r"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")), space, positives + 1, same=True)
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("vec_id")), 1, positives)
    pairs = written(asking.select("vec_id", "k1", "k2").join(near, ["k1", "k2"]).select("vec_id", "k1", "k2", F.explode(others).alias("p")).select(F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("p.s").alias("r"), "k1", "k2"))
    share = lambda per_cent: F.col("r").cast("decimal(20,0)") * per_cent / F.lit(100).cast("decimal(3,0)")
    bounds = [F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi")]
    ranges = pairs.select("k1", "k2", "r").distinct().select("*", *bounds).where("lo <= hi").join(heads, ["k1", "k2"])
    hard = search(index, ranges, space, negatives, same=False)
    found = pairs.join(hard, ["k1", "k2", "r"]).select("anchor_id", "positive_id", "r", F.posexplode("top").alias("at", "t"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("negative_id"), F.col("r").alias("positive_score"), F.col("t.s").alias("negative_score"))
