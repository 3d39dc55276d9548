"""Features of each (cell, gene): proximity, asymmetry, dispersion, Ripley, rank and permutation scores.

Distances and tests are made once for a point (a join of its cell's outline), then one aggregation gives most features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planar, stats
from ..sources import store
from . import geometry, joins, whole

KEYS = ["cell", "gene"]
WHOLE_CELL = 1_000_000  # points of a cell that a permutation task looks up by itself; points of larger ones are joined


def placed(tx: DataFrame, shapes: DataFrame, limits: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Transcripts with their cell's and nucleus' measures, distances and tests (null where the outline is missing).

    Each outline is tested once for a point, whole Arrow batches at a time. What is known of a cell, and ``limits`` (keys, t1, t2,
    t3) if there are any, is put in one row first, so points are joined once.
    """
    c = shapes.where("kind = 'cell'").select("cell", *[F.col(x).alias(f"c_{x}") for x in ("flat", "gx", "gy", "mx", "my", "radius", "span", "area", "eq_radius")])
    n = shapes.where("kind = 'nucleus'").select("cell", *[F.col(x).alias(f"n_{x}") for x in ("flat", "gx", "gy", "eq_radius")])
    cells = c.join(n, "cell", "left")
    p = tx.join(cells if limits is None else cells.join(limits, "cell"), keys or ["cell"])
    p = p.withColumns({"_c": planar.against("c_flat", "x", "y"), "_n": planar.against("n_flat", "x", "y")}).drop("c_flat", "n_flat")
    inside, edge = (lambda k: F.col(k)["inside"]), (lambda k: F.col(k)["edge"])
    return p.withColumns({
        "dc": F.col("_c")["dist"], "dn": F.col("_n")["dist"], "in_cell": inside("_c") | edge("_c"),
        "in_nucleus": inside("_n") & ~edge("_n"), "on_nucleus": inside("_n") | edge("_n"),
    }).drop("_c", "_n")


def _split(value: Column, inner: bool) -> Column:
    """Mean over points inside or outside the nucleus; 0 where there are none; null without a nucleus."""
    cond = F.col("in_nucleus") if inner else ~F.col("in_nucleus")
    return F.when(F.max(F.col("dn").isNotNull()), F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0)))


def point_features(p: DataFrame) -> DataFrame:
    """Proximity and asymmetry: 1 - mean distance / radius, and mean distance to a centroid / radius."""
    r = F.max("c_radius")
    dist = lambda a, b: geometry.length(F.col("x") - F.col(a), F.col("y") - F.col(b))
    near = lambda inner: F.when(F.max(F.col("dn").isNotNull()), F.coalesce((r - F.avg(F.when(F.col("in_nucleus") if inner else ~F.col("in_nucleus"), F.col("dn")))) / r, F.lit(0.0)))
    return p.groupBy(*KEYS).agg(
        F.count("*").alias("n_spots"),
        ((r - F.avg("dc")) / r).alias("cell_inner_proximity"),
        near(True).alias("nucleus_inner_proximity"),
        near(False).alias("nucleus_outer_proximity"),
        (F.avg(dist("c_gx", "c_gy")) / r).alias("cell_inner_asymmetry"),
        (_split(dist("n_gx", "n_gy"), True) / r).alias("nucleus_inner_asymmetry"),
        (_split(dist("n_gx", "n_gy"), False) / r).alias("nucleus_outer_asymmetry"),
    )


def distance_features(p: DataFrame) -> DataFrame:
    """Plain means: distances to outlines and centroids inside and outside, share inside the nucleus."""
    dist = geometry.length(F.col("x") - F.col("n_gx"), F.col("y") - F.col("n_gy"))
    inside = F.col("in_nucleus")
    return p.groupBy(*KEYS).agg(
        F.avg(F.when(inside, F.col("dn"))).alias("nucleus_inner_distance"), F.avg(F.when(~inside, F.col("dn"))).alias("nucleus_outer_distance"),
        F.avg(F.when(inside, dist)).alias("nucleus_inner_offset"), F.avg(F.when(~inside, dist)).alias("nucleus_outer_offset"),
        F.avg(inside.cast("double")).alias("nucleus_enrichment"), F.lit(1.0).alias("cell_enrichment"),
    )


def dispersion(tx: DataFrame, shapes: DataFrame, step: int = 1) -> DataFrame:
    """Second moments of the points over those of the cell's raster about the same centre.

    The raster's moment about any centre m is E|r|^2 - 2 m.E r + |m|^2, so the raster is summed once for a cell.
    """
    n = shapes.where("kind = 'nucleus'").select("cell", F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    g = tx.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("a2"))
    g = g.join(geometry.raster_sums(shapes.where("kind = 'cell'"), step), "cell").join(n, "cell", "left")
    about = lambda m, x, y, cx, cy: F.col(m) - 2 * (F.col(cx) * F.col(x) + F.col(cy) * F.col(y)) + F.col(cx) * F.col(cx) + F.col(cy) * F.col(cy)
    return g.select(
        *KEYS, about("a2", "ax", "ay", "ax", "ay").alias("point_moment"),
        (about("a2", "ax", "ay", "ax", "ay") / about("r_2", "r_x", "r_y", "ax", "ay")).alias("point_dispersion_norm"),
        (about("a2", "ax", "ay", "nx", "ny") / about("r_2", "r_x", "r_y", "nx", "ny")).alias("nucleus_dispersion_norm"),
    )


def ripley_counts(tx: DataFrame, shapes: DataFrame, limit: int = whole.LIMIT) -> DataFrame:
    """(cell, gene, n, area, span, hist): numbers of ordered pairs closer than each radius 1..span/2, and than span/4.

    Pairs of one (cell, gene) within half the cell's own span count, and only their numbers by radius are kept. Cells of at most
    ``limit`` points are worked on in a task each; pairs of larger ones come from the grid join.
    """
    s = shapes.where("kind = 'cell'").select("cell", "area", "span")
    small, large = whole.parted(whole.stored(tx), ["cell"], limit)
    rows = small.select(*KEYS, "tx_id", "x", "y").repartition("cell").join(s, "cell")
    schema = f"cell string, gene string, n long, area double, span {s.schema['span'].dataType.simpleString()}, hist map<int,long>, quarter long"
    out = whole.mapped(rows, ["cell"], _ripley_rows, schema, ["gene"], sent=True)
    return out if large is None else out.unionByName(_spread_ripley(large, s))


def _ripley_rows(t: pa.Table, cuts: np.ndarray) -> pa.Table:
    """One row a cell and gene: its pairs by radius."""
    gene, values = whole.codes(t.column("gene"))
    x, y, span = whole.numbers(t, "x", "y", "span")
    ids = whole.codes(t.column("tx_id"))[0]
    n = t.num_rows
    new = np.zeros(n, bool)
    new[cuts[:-1]] = True
    new[1:] |= gene[1:] != gene[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, n))
    of = np.repeat(np.arange(len(starts)), size)
    end = (starts + size)[of]
    k = np.floor(span[starts] / 2).astype(np.int64)  # radii are linspace(1, span / 2, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(k > 1, (span[starts] / 2 - 1) / (k - 1), 1.0)
    reach = np.maximum(1.0, span[starts] / 2)
    wide = int(max(1, (np.floor((reach - 1) / step) + 2).max())) if len(starts) else 1
    quarter, bins = np.zeros(len(starts), np.int64), []
    with_others = (end - np.arange(n) - 1) * (np.isfinite(x) & np.isfinite(y) & (ids >= 0) & (gene >= 0))
    ends = np.cumsum(with_others)
    lo = 0
    while lo < n:  # as many points at a time as have about a million partners
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
        many = with_others[lo:hi]
        a = np.repeat(np.arange(lo, hi), many)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        dx, dy, g = x[a] - x[b], y[a] - y[b], of[a]
        d2 = dx * dx + dy * dy
        near = (d2 <= reach[g] * reach[g]) & (ids[a] != ids[b])
        g, d = g[near], np.sqrt(d2[near])
        i = np.where(d < 1, 0, np.maximum(0, np.floor((d - 1) / step[g]).astype(np.int64) + 1))
        bins.append(np.unique(g * wide + i, return_counts=True))
        quarter += np.bincount(g[d < span[starts][g] / 4], minlength=len(quarter))
        lo = hi
    code, inverse = np.unique(np.concatenate([c for c, _ in bins]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([c for _, c in bins]), minlength=len(code)).astype(np.int64)
    at, i = np.divmod(code, wide)
    offsets = np.searchsorted(at, np.arange(len(starts) + 1))
    none = np.diff(offsets) == 0
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), pa.array(i, pa.int32()), pa.array(count))
    return pa.table([*whole.taken(t, ["cell"], starts), whole.texts(values, gene[starts]), pa.array(size), *whole.taken(t, ["area", "span"], starts), maps, pa.array(quarter, mask=none)], names=["cell", "gene", "n", "area", "span", "hist", "quarter"])


def _spread_ripley(tx: DataFrame, s: DataFrame) -> DataFrame:
    n = tx.groupBy(*KEYS).agg(F.count("*").alias("n")).join(s, "cell")
    spans = tx.join(s, "cell")
    spans = spans.withColumn("reach", F.greatest(F.lit(1.0), F.col("span") / 2))
    pairs = joins.distance_pairs(spans, "reach", KEYS, carry=["span"])
    d = F.sqrt("d2")
    k = F.floor(F.col("a.span") / 2).cast("int")  # radii are linspace(1, span / 2, k)
    step = F.when(k > 1, (F.col("a.span") / 2 - 1) / (k - 1)).otherwise(F.lit(1.0))
    first = F.greatest(F.lit(0), F.floor((d - 1) / step).cast("int") + 1)  # index of the first radius above d
    bins = pairs.select(*KEYS, F.when(d < F.col("a.span") / 4, 1).otherwise(0).alias("q"), F.when(d < 1, 0).otherwise(first).alias("i"), k.alias("k"))
    bins = bins.groupBy(*KEYS, "i").agg(F.count("*").alias("c"), F.sum("q").alias("q")).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("hist"), F.sum("q").alias("quarter"))
    return n.join(bins, KEYS, "left").select(*KEYS, "n", "area", "span", "hist", "quarter")


def ripley(tx: DataFrame, shapes: DataFrame) -> DataFrame:
    """Summary of H(r) = L(r) - r: greatest value, gradients of its rolling mean of five, rank correlation with r, value at span/4."""

    def run(batches):
        for b in batches:
            rows = [stats.ripley_summary(n, a, s, dict(h) if h is not None else {}, q) for n, a, s, h, q in zip(b["n"], b["area"], b["span"], b["hist"], b["quarter"].fillna(0), strict=True)]
            out = pd.DataFrame(rows, columns=["l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius"])
            out.insert(0, "gene", b["gene"].to_numpy())
            out.insert(0, "cell", b["cell"].to_numpy())
            yield out

    return ripley_counts(tx, shapes).select(*KEYS, "n", "area", "span", "hist", "quarter").mapInPandas(run, "cell string, gene string, l_max double, l_max_gradient double, l_min_gradient double, l_monotony double, l_half_radius double")


def _rank_score(tx: DataFrame, dist: Column, name: str) -> DataFrame:
    """(E - median rank) / (E - 1), E = (n + 1) / 2, ranks by distance in the cell, ties by tx_id; null in a one-spot cell."""
    w = Window.partitionBy("cell")
    r = tx.select(*KEYS, F.row_number().over(w.orderBy(dist, "tx_id")).alias("rank"), F.count("*").over(w).alias("n"))
    g = r.groupBy(*KEYS).agg(F.count("*").alias("num_gene_spots"), F.max("n").alias("num_spots"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    e = (F.col("num_spots") + 1) / 2
    return g.withColumn(name, F.when(F.col("num_spots") > 1, (e - F.col("median_rank")) / (e - 1)))


def ranks(p: DataFrame) -> DataFrame:
    """(cell, gene, peripheral, central): both rank scores from one pass over the points."""
    w = Window.partitionBy("cell")
    dx, dy = F.col("x") - F.col("c_mx"), F.col("y") - F.col("c_my")
    r = p.select(*KEYS, "tx_id", "dc", (dx * dx + dy * dy).alias("_d"))
    r = r.select(*KEYS, F.row_number().over(w.orderBy("dc", "tx_id")).alias("_p"), F.row_number().over(w.orderBy("_d", "tx_id")).alias("_c"), F.count("*").over(w).alias("n"))
    g = r.groupBy(*KEYS).agg(F.max("n").alias("n"), F.percentile("_p", F.lit(0.5)).alias("_p"), F.percentile("_c", F.lit(0.5)).alias("_c"))
    e = (F.col("n") + 1) / 2
    return g.select(*KEYS, *[F.when(F.col("n") > 1, (e - F.col(c)) / (e - 1)).alias(name) for c, name in (("_p", "peripheral"), ("_c", "central"))])


def peripheral(p: DataFrame) -> DataFrame:
    return _rank_score(p, F.col("dc"), "peripheral")


def central(p: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.col("c_mx"), F.col("y") - F.col("c_my")
    return _rank_score(p, dx * dx + dy * dy, "central")


def _permutation(tx: DataFrame, shapes: DataFrame, name: str, measure: str, iterations: int, pairs: int, seed: int, whole: int) -> DataFrame:
    """Score from a null of label permutations within a cell; genes of one spot are left out first.

    A null value needs a few pairs of a random set of the cell's points, so it is drawn as numbers of points (by tx_id) from the
    cell, the size of the set and the seed alone. Cells of at most ``whole`` points look them up in their task. In larger ones
    points are numbered over tasks and joined by their number; the values are the same.
    """
    m = shapes.where("kind = 'cell'").select("cell", "mx", "my")
    genes = tx.groupBy(*KEYS).agg(F.count("*").alias("k")).where("k >= 2")
    sizes = genes.groupBy("cell").agg(F.sum("k").alias("n")).join(m, "cell")
    rows = tx.select("cell", "gene", "tx_id", "x", "y").join(genes.select(*KEYS), KEYS, "left_semi").join(sizes, "cell")
    schema = f"cell string, gene string, num_gene_spots long, {name} double, variance double"
    of = stats.pair_distances if measure == "distance" else stats.pair_angles
    half, variance = iterations / 2, (iterations + 2) / (3 * iterations)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tx_id")
        cell, xy, centre = g["cell"].iloc[0], g[["x", "y"]].to_numpy(), g[["mx", "my"]].iloc[0].to_numpy()
        key = (seed, stats.stable_seed(cell))
        nulls: dict[int, np.ndarray] = {}
        out = []
        for gene, at in sorted(g.groupby("gene").indices.items()):
            k = len(at)
            if k not in nulls:
                p = stats.null_pairs(len(xy), k, iterations, pairs, (*key, k))
                nulls[k] = of(xy[p[..., 0]], xy[p[..., 1]], centre).mean(axis=1)
            p = xy[at][stats.observed_pairs(k, pairs, (*key, stats.stable_seed(gene)))]
            below = int((nulls[k] < of(p[:, 0], p[:, 1], centre).mean()).sum())
            out.append((cell, gene, k, (half - below) / half, variance))
        return pd.DataFrame(out, columns=["cell", "gene", "num_gene_spots", name, "variance"])

    small = rows.where(F.col("n") <= whole).select("cell", "gene", "tx_id", "x", "y", "mx", "my").groupBy("cell").applyInPandas(run, schema)
    large = sizes.where(F.col("n") > whole)
    return small.unionByName(_by_number(rows.where(F.col("n") > whole), large, genes, name, of, iterations, pairs, seed))


def _by_number(rows: DataFrame, sizes: DataFrame, genes: DataFrame, name: str, of: Callable, iterations: int, pairs: int, seed: int) -> DataFrame:
    """The scores of cells whose points are joined by their numbers; sizes: cell, n, mx, my."""
    numbered = store.stored(_numbered(_numbered(rows.select("cell", "gene", "tx_id", "x", "y"), ["cell"], "i"), KEYS, "j"))
    wanted = genes.join(sizes, "cell")

    def nulls(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                p = stats.null_pairs(r.n, r.k, iterations, pairs, (seed, stats.stable_seed(r.cell), r.k)).reshape(-1, 2)
                yield pd.DataFrame({"cell": r.cell, "k": r.k, "draw": np.arange(len(p)) // pairs, "a": p[:, 0], "b": p[:, 1], "mx": r.mx, "my": r.my})

    def observed(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                p = stats.observed_pairs(r.k, pairs, (seed, stats.stable_seed(r.cell), stats.stable_seed(r.gene)))
                yield pd.DataFrame({"cell": r.cell, "gene": r.gene, "k": r.k, "a": p[:, 0], "b": p[:, 1], "mx": r.mx, "my": r.my})

    def measured(p: DataFrame, keys: list[str], number: str) -> DataFrame:
        for end in ("a", "b"):
            at = numbered.select(*keys, F.col(number).alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"))
            p = p.join(at, [*keys, end])

        def run(batches):
            for d in batches:
                far = of(d[["ax", "ay"]].to_numpy(), d[["bx", "by"]].to_numpy(), d[["mx", "my"]].to_numpy())
                yield d[kept].assign(d=far)

        kept = [c for c in p.columns if c not in ("a", "b", "mx", "my", "ax", "ay", "bx", "by")]
        return p.mapInPandas(run, ", ".join(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in kept) + ", d double")

    draws = wanted.select("cell", "k", "n", "mx", "my").distinct().mapInPandas(nulls, "cell string, k long, draw long, a long, b long, mx double, my double")
    null = measured(draws, ["cell"], "i").groupBy("cell", "k", "draw").agg(F.avg("d").alias("null"))
    seen = measured(wanted.select("cell", "gene", "k", "mx", "my").mapInPandas(observed, "cell string, gene string, k long, a long, b long, mx double, my double"), KEYS, "j").groupBy(*KEYS, "k").agg(F.avg("d").alias("seen"))
    g = seen.join(null, ["cell", "k"]).groupBy(*KEYS, "k").agg(F.count_if(F.col("null") < F.col("seen")).alias("below"))
    half = F.lit(iterations / 2)
    return g.select(*KEYS, F.col("k").alias("num_gene_spots"), ((half - F.col("below")) / half).alias(name), F.lit((iterations + 2) / (3 * iterations)).alias("variance"))


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the number of each row within its keys by tx_id, from 0. Rows are sorted by range, so a key may span many tasks."""
    sorted_rows = store.stored(rows.repartitionByRange(*keys, "tx_id").withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = sorted_rows.groupBy(*keys, "_p").agg(F.count("*").alias("_c")).select(*keys, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("tx_id")) - 1
    return sorted_rows.withColumn("_r", inside).join(start, [*keys, "_p"]).withColumn(name, F.col("_s") + F.col("_r")).drop("_p", "_r", "_s")


def punctate(tx: DataFrame, shapes: DataFrame, iterations: int = 200, pairs: int = 4, seed: int = 1, whole: int = WHOLE_CELL) -> DataFrame:
    return _permutation(tx, shapes, "punctate", "distance", iterations, pairs, seed, whole)


def radial(tx: DataFrame, shapes: DataFrame, iterations: int = 200, pairs: int = 4, seed: int = 1, whole: int = WHOLE_CELL) -> DataFrame:
    return _permutation(tx, shapes, "radial", "angle", iterations, pairs, seed, whole)


def median_variance(counts: DataFrame) -> DataFrame:
    """Exact variance of the rank score under the null, from num_gene_spots m and num_spots n.

    The middle ranks of m numbers drawn from 1..n have known moments; the median's variance follows from them. Null where there
    is one point or none, or m is no number of points out of n.
    """
    m, n = F.col("num_gene_spots"), F.col("num_spots")
    of_median = (n + 1) * (n - m).cast("double") / (4 * (m + 2)) * F.when(m % 2 == 1, 1.0).otherwise(m / (m + 1))
    return counts.withColumn("variance", F.when((n >= 2) & (m >= 1) & (m <= n), of_median / F.pow((n + 1) / 2 - 1, 2)))


def median_p_values(scores: DataFrame) -> DataFrame:
    """Adds p_median, the exact two-sided p-value of a rank score's median; worked out once for each distinct case."""
    keys = ["num_gene_spots", "num_spots", "median_rank"]

    def run(batches):
        for b in batches:
            yield b.assign(p_median=[stats.median_p_value(int(m), int(n), q) for m, n, q in b[keys].itertuples(index=False)])

    known = scores.select(*keys).distinct().mapInPandas(run, "num_gene_spots long, num_spots long, median_rank double, p_median double")
    return scores.join(known, keys, "left")


def baseline(tx: DataFrame) -> DataFrame:
    """A score that says nothing, to test what comes after: 0 with variance 1 for each (cell, gene)."""
    g = tx.groupBy(*KEYS).agg(F.count("*").alias("num_gene_spots"))
    total = F.sum("num_gene_spots").over(Window.partitionBy("cell"))
    return g.withColumns({"num_spots": total, "baseline": F.lit(0.0), "variance": F.lit(1.0)})


#: Scores by name: functions of transcripts, shapes and options.
SCORES: dict[str, Callable[..., DataFrame]] = {
    "peripheral": lambda tx, shapes: peripheral(placed(tx, shapes)),
    "central": lambda tx, shapes: central(placed(tx, shapes)),
    "punctate": punctate,
    "radial": radial,
    "baseline": lambda tx, shapes: baseline(tx),
}


def score(name: str, tx: DataFrame, shapes: DataFrame, **options) -> DataFrame:
    """The score of that name as columns metric, cell, gene, ..., score."""
    if name not in SCORES:
        raise ValueError(f"no score {name}; there are {', '.join(sorted(SCORES))}")
    return SCORES[name](tx, shapes, **options).withColumnRenamed(name, "score").withColumn("metric", F.lit(name))


def gene_group_scores(scores: DataFrame, score: str, group: str, min_cells: int = 5) -> DataFrame:
    """Per (gene, group): z = sum of scores / sqrt(sum of variances), two-sided p, Benjamini-Hochberg within the table."""
    g = scores.where(F.col(score).isNotNull() & F.col("variance").isNotNull()).groupBy("gene", group).agg(F.count_distinct("cell").alias("num_cells"), F.avg("num_gene_spots").alias("mean_gene_spots"), F.percentile(score, F.lit(0.5)).alias("median_score"), (F.sum(score) / F.sqrt(F.sum("variance"))).alias("z")).where(F.col("num_cells") >= min_cells)
    return stats.benjamini_hochberg(g.withColumn("p", stats.two_sided_normal(F.col("z"))), "p", ["gene", group])


def read_position_score(reads: DataFrame, stratum: str, position: str) -> DataFrame:
    """(median position - middle) / half span of each stratum's reads; null where they span nothing."""
    mid, half = (F.col("hi") + F.col("lo")) / 2, (F.col("hi") - F.col("lo")) / 2
    g = reads.groupBy(stratum).agg(F.percentile(position, F.lit(0.5)).alias("med"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("n"))
    return g.select(stratum, "n", F.when(half > 0, (F.col("med") - mid) / half).alias("score"))


#: Features that the pattern classes rest on.
PATTERN_FEATURES = (
    "cell_inner_proximity", "nucleus_inner_proximity", "nucleus_outer_proximity", "cell_inner_asymmetry", "nucleus_inner_asymmetry",
    "nucleus_outer_asymmetry", "l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius", "point_dispersion_norm",
    "nucleus_dispersion_norm",
)


def pattern_features(tx: DataFrame, shapes: DataFrame) -> DataFrame:
    """The 13 features of the pattern classes, one row a (cell, gene)."""
    tx = whole.stored(tx)  # three passes
    out = point_features(placed(tx, shapes)).drop("n_spots")
    for part in (dispersion(tx, shapes).drop("point_moment"), ripley(tx, shapes)):
        out = out.join(part, KEYS, "full")
    return out.select(*KEYS, *PATTERN_FEATURES)


def feature_table(tx: DataFrame, shapes: DataFrame, iterations: int = 200, pairs: int = 4) -> DataFrame:
    """All features, one row a (cell, gene), outer-joined."""
    p = placed(tx, shapes)
    out = point_features(p).drop("n_spots")
    for part in (dispersion(tx, shapes).drop("point_moment"), ripley(tx, shapes), peripheral(p).select(*KEYS, "peripheral"), central(p).select(*KEYS, "central"), punctate(tx, shapes, iterations, pairs).select(*KEYS, "punctate"), radial(tx, shapes, iterations, pairs).select(*KEYS, "radial")):
        out = out.join(part, KEYS, "full")
    return out
