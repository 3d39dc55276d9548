"""Near-duplicate components by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash, so b bands of r rows need b * r / 2 hash
evaluations of a shingle. Texts with one band in common are candidates; what is reported rests on exact set sizes.

Plan, in steps of bounded memory:

1. One pass over the texts: set size, a 128-bit identity of the shingle set, the band keys. Equal sets become one node
   (combined before the shuffle), so groups of exact copies of any size cost one row a task.
2. Band keys that several nodes share link each of these nodes with the least of them; components of these links are
   *families*. All candidate pairs lie within a family.
3. Families are cut into blocks of bounded bytes. A task counts exact intersections from postings of the shingles that texts
   not yet connected share, and returns a spanning set of true links only: fewer rows than texts, never all pairs.
   First each block by itself; then, of families with several blocks, one text of each component found so far, pairs of blocks
   spread over tasks; last, only families that still fall apart compare whole blocks pair by pair. So a family of near copies
   of any size, which one text of it connects, costs no quadratic step.
4. Components of the true links, joined back to all texts.

Bands have ``rows`` values, and there are as many bands as make a link at the threshold missed with a chance of at most
``miss``. At 8 values texts of similarity 0.05 meet with a chance of 2e-9, so families stay small up to very many texts.

Defined results: rows with equal doc_id are one node; a null text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of all of them; rows with a null doc_id have a null component and are
kept; ids are whole numbers (an error says so if the column has another type); texts are read whole; an empty table gives an
empty one; extra columns are ignored, whatever their names. ``keep_representatives`` keeps, of rows with one doc_id and
different texts, the one of the least text, and every row with a null doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, by_group, grams, mix, release, signed, to_bytes, trimmed, written
from .graph import components


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer; none of no words."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(size, len(words))))


class MinMax:
    """Band keys of shingle sets: two values a permutation."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        self.perms = (bands * rows + 1) // 2
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 31, self.perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.perms, dtype=np.uint64)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """len(sets) x bands keys; no set may be empty."""
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        flat = mix(flat)
        sig = np.empty((len(sets), 2 * self.perms), np.uint32)
        for k in range(self.perms):
            h = ((flat * self.mul[k] + self.add[k]) >> np.uint64(32)).astype(np.uint32)
            sig[:, 2 * k] = np.minimum.reduceat(h, starts)
            sig[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
        out = np.zeros((len(sets), self.bands), np.uint64)
        for r in range(self.rows):  # values of one permutation go to different bands
            out = mix(out + sig[:, r * self.bands : (r + 1) * self.bands].astype(np.uint64) + np.uint64(1))
        return out


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): identity and band keys of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minmax = WordHashes(), MinMax(bands, rows)
        for b in batches:
            ids, texts, at = b.column("doc_id"), b.column("text").to_pylist(), 0
            while at < len(texts):
                sets: list[np.ndarray] = []
                size = 0
                while at + len(sets) < len(texts) and size < 400_000:
                    sets.append(shingle_set(hashes.of(to_bytes(texts[at + len(sets)]).translate(ASCII_LOWER).split()), shingle))
                    size += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, signed(minmax.keys([sets[i] for i in full])), strict=True):
                        keys[i] = k
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                cols = [ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "h1", "h2", "keys"])
                at += len(sets)
        del hashes, minmax
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def linked(inter: np.ndarray, n: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Exact test of 100 * intersection >= percent * union."""
    return 100 * inter >= percent * (n + others - inter)


def bands_for(percent: int, rows: int, miss: float = 1e-6) -> int:
    """The number of bands that a pair at the threshold shares none of with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def spanning_links(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join whatever is linked but not yet of one label. Postings within one component are left out."""
    n = len(sets)
    lab = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].reshape(-1)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    f, o = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    width = np.diff(np.r_[start, len(f)])
    of = np.empty(len(f), np.int64)
    of[order] = np.repeat(np.arange(len(start)), width)
    ends = np.cumsum(sizes)
    out: list[tuple[int, int]] = []

    def mixed() -> np.ndarray:
        """Shingles whose owners are of several components: only these can tell of a link that is still wanted."""
        return np.minimum.reduceat(lab[o], start) != np.maximum.reduceat(lab[o], start)

    live, joined = mixed(), 0
    for i in np.argsort(sizes, kind="stable").tolist():
        g = of[ends[i] - sizes[i] : ends[i]]
        g = g[live[g]]
        if not len(g):
            continue
        w = width[g]
        other = o[np.repeat(start[g] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum())]
        j, inter = np.unique(other[lab[other] != lab[i]], return_counts=True)
        j = j[linked(inter, int(sizes[i]), sizes[j], percent)]
        if len(j):
            found, first = np.unique(lab[j], return_index=True)
            out += [(i, int(x)) for x in j[first]]
            lab[np.isin(lab, found)] = lab[i]
            joined += len(found)
            if 10 * joined >= n:
                live, joined = mixed(), 0
    return out


def _links(texts: DataFrame, shingle: int, percent: int, block_bytes: int) -> DataFrame:
    """True links (u, v) between the nodes that meet in a task. texts: node, text, component, slots of (family, a, b)."""
    names = ["family", "a", "b", "node", "component", "shingles"]

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out, held = [], 0
            for node, text, component, where in zip(b["node"], b["text"], b["component"], b["slots"], strict=True):
                s = shingle_set(hashes.of(to_bytes(text).translate(ASCII_LOWER).split()), shingle)
                if not len(s):
                    continue
                raw = s.tobytes()
                out += [(at["family"], at["a"], at["b"], node, component, raw) for at in where]
                held += len(raw) * len(where)
                if held > block_bytes:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    def links_of(g: pd.DataFrame) -> dict | None:
        if len(g) < 2:
            return None
        node = g["node"].to_numpy()
        found = spanning_links([np.frombuffer(x, np.uint64) for x in g["shingles"]], percent, g["component"].to_numpy())
        return {"u": node[[i for i, _ in found]], "v": node[[j for _, j in found]]} if found else None

    sets = texts.mapInPandas(sets_of, "family long, a int, b int, node long, component long, shingles binary")
    return by_group(sets, ["family", "a", "b"], links_of, "u long, v long")


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 8, bands: int | None = None, block_bytes: int = 8_000_000, temps: list | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id it reaches through links), kept.

    A link is 100 * intersection >= percent * union of the sets of ``shingle``-word shingles. Tables written on the way are added
    to ``temps``; they can be released when the result has been written.
    """
    temps = [] if temps is None else temps
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("near_components: doc_id has to be a whole number; number the rows first")
    bands = bands or bands_for(percent, rows)
    sig = written(signatures(docs, shingle, bands, rows))
    nodes = sig.where("n_shingles > 0 and doc_id is not null")
    named = written(nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    reps = nodes.withColumnRenamed("doc_id", "node").join(named, ["h1", "h2", "node"], "left_semi")
    # 2. families
    keyed = reps.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keyed.join(shared, ["band", "key"]).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    family = components(stars).withColumnRenamed("id", "node").withColumnRenamed("component", "family")
    # 3. exact links: each block by itself
    sizes = reps.select("node", "n_shingles").join(family, "node")
    blocks = sizes.groupBy("family").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + 64) / block_bytes).cast("int").alias("blocks"))
    placed = written(family.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where(F.col("node").isNotNull())
    alone = placed.select("node", F.col("node").alias("component"), F.array(F.struct("family", F.col("block").alias("a"), F.col("block").alias("b"))).alias("slots"))
    links = written(_links(texts.join(alone, "node"), shingle, percent, block_bytes))
    temps += [sig, named, placed, links]
    true = components(links)
    # then pairs of blocks: one text of each component; then all of the families that still have several
    several = placed.where("blocks > 1")
    pair = lambda k: F.struct("family", F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b"))
    for whole in (False, True) if several.take(1) else ():
        at = several.join(true.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        if whole:
            apart = at.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
            at = at.join(apart, "family", "left_semi")
        else:
            first = at.groupBy("family", "block", "component").agg(F.min("node").alias("node"))
            at = at.join(first.select("node"), "node", "left_semi")
        slots = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")), pair)
        more = written(_links(texts.join(written(at.select("node", "component", slots.alias("slots"))), "node"), shingle, percent, block_bytes))
        temps.append(more)
        links = links.union(more)
        true = components(links)
    true = true.withColumnRenamed("id", "node")
    # 4. back to the texts
    ids = nodes.join(named, ["h1", "h2"]).groupBy("doc_id").agg(F.min("node").alias("v"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    same_ids = written(ids.select(F.explode("all").alias("u"), "v").where("u <> v"))
    temps.append(same_ids)
    if same_ids.take(1):  # different texts under one id join their nodes
        true = components(true.select(F.col("node").alias("u"), F.col("component").alias("v")).union(same_ids)).withColumnRenamed("id", "node")
    final = named.join(true, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    same_id = sig.select("doc_id", "n_shingles", "h1", "h2")
    out = same_id.join(final, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()))


def keep_representatives(docs: DataFrame, **kw) -> DataFrame:
    """One row, all columns, of each near-duplicate component; rows with a null doc_id stay."""
    temps: list[DataFrame] = []
    kept = written(near_components(docs, temps=temps, **kw).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")))
    release(*temps)
    # the kept ids are nearly as many as the documents, so they are never to be broadcast
    out = docs.alias("d").join(kept.alias("k").hint("merge"), F.col("d.doc_id") == F.col("k.doc_id"), "left_semi")
    if kept.where("_rows > 1").take(1):  # rows of one doc_id are one document: that of the least text
        # fields by number, whatever the columns' names; of equal texts the least JSON of the row, since maps have no order
        row = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns)])
        least = F.min_by(row, F.struct(F.col("text").alias("a"), F.to_json(row).alias("b"))).alias("row")
        out = out.groupBy("doc_id").agg(least).select(*[F.col("row")[f"f{i}"].alias(c) for i, c in enumerate(docs.columns)])
    return out.union(docs.where("doc_id is null"))
