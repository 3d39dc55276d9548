"""Gene-gene colocalization: proximal pairs in each cell, the conditional global test, and what is read off them.

All tables are sparse: a pair that never meets in a cell has p = 1 there and no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import store
from . import joins, whole

PAIR = ["g1", "g2"]
#: Tasks that fit pairs; sets of genes that every task may hold.
FITS = 64
HELD = 100_000


def pair_key(a, b):
    return F.concat_ws("--", F.least(a, b), F.greatest(a, b))


def gene_counts(tx: DataFrame, keys: list[str]) -> DataFrame:
    return tx.groupBy(*keys, "gene").agg(F.count("*").alias("n"))


def pair_counts(tx: DataFrame, radius: float, keys: list[str], dims: tuple[str, ...] = ("x", "y"), limit: int = whole.LIMIT) -> DataFrame:
    """(keys, g1, g2, obs) with g1 <= g2: unordered close pairs of points."""
    return met_pairs(tx, radius, keys, dims, limit).select(*keys, *PAIR, "obs")


def met_pairs(tx: DataFrame, radius: float, keys: list[str], dims: tuple[str, ...] = ("x", "y"), limit: int = whole.LIMIT) -> DataFrame:
    """(keys, g1, g2, obs, n1, n2, total, close): close pairs of points, points of both genes, all points and close pairs of the key.

    Keys of at most ``limit`` points are worked on in a task each, so their pairs are sent nowhere.
    """
    small, large = whole.parted(tx, keys, limit)
    out = whole.gene_pairs(small, keys, radius, dims)
    return out if large is None else out.unionByName(_spread_pairs(large, radius, keys, dims))


def _spread_pairs(tx: DataFrame, radius: float, keys: list[str], dims: tuple[str, ...]) -> DataFrame:
    p = joins.distance_pairs(tx, radius, keys, dims, carry=["gene"])
    obs = p.groupBy(*keys, F.least("a.gene", "b.gene").alias("g1"), F.greatest("a.gene", "b.gene").alias("g2")).agg(F.count("*").alias("obs"))
    counts = gene_counts(tx, keys)
    n = lambda g, name: counts.select(*keys, F.col("gene").alias(g), F.col("n").alias(name))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total")).join(obs.groupBy(*keys).agg(F.sum("obs").alias("close")), keys)
    return obs.join(total, keys).join(n("g1", "n1"), [*keys, "g1"], "left").join(n("g2", "n2"), [*keys, "g2"], "left").select(*keys, *PAIR, "obs", "n1", "n2", "total", "close")


def proximal_pairs(tx: DataFrame, radius: float = 4.0, min_genecount: int = 20, group: str | None = None, dims: tuple[str, ...] = ("x", "y"), p_values: bool = True, limit: int = whole.LIMIT) -> DataFrame:
    """(cell, g1, g2, obs, trials, p0[, pvalue]) of pairs that meet, in cells of more than min_genecount points.

    p0 is the share of close pairs among all, 1 where there are none; trials are the product of the counts, the square on the
    diagonal. A group column becomes part of every key: all groups are one job.
    """
    keys = ([group] if group else []) + ["cell"]
    met = met_pairs(tx, radius, keys, dims, limit).where((F.col("total") > min_genecount) & F.col("g1").isNotNull() & F.col("g2").isNotNull())
    out = met.select(*keys, *PAIR, "obs", (F.col("n1") * F.col("n2")).alias("trials"), (2 * F.col("close") / (F.col("total") * (F.col("total") - 1))).alias("p0"))
    return out.withColumn("pvalue", stats.binomial_tail_udf("obs", "trials", "p0")) if p_values else out


def proximal_pairs_by_slice(tx: DataFrame, radius: float = 4.0, min_genecount: int = 20, p_values: bool = True, limit: int = whole.LIMIT) -> DataFrame:
    """As proximal_pairs with distances within z slices: counts and trials are summed, p0 is weighted by the numbers of pairs."""
    small, large = whole.parted(tx.select("cell", "z", "tx_id", "gene", "x", "y"), ["cell"], limit)
    out = whole.sliced_pairs(small, radius, min_genecount)
    out = out if large is None else out.unionByName(_spread_slices(large, radius, min_genecount))
    return out.withColumn("pvalue", stats.binomial_tail_udf("obs", "trials", "p0")) if p_values else out


def _spread_slices(tx: DataFrame, radius: float, min_genecount: int) -> DataFrame:
    s = store.stored(proximal_pairs(tx, radius, min_genecount, group="z", p_values=False))
    counts = store.stored(gene_counts(tx, ["z", "cell"]))
    size = counts.groupBy("z", "cell").agg(F.sum("n").alias("total")).where(F.col("total") > min_genecount)
    close = s.groupBy("z", "cell").agg(F.sum("obs").alias("close"))
    w = size.join(close, ["z", "cell"], "left").withColumn("pairs", F.col("total") * (F.col("total") - 1) / 2)
    p0 = w.groupBy("cell").agg((F.sum(F.when(F.col("close") > 0, F.col("close")).otherwise(F.col("pairs"))) / F.sum("pairs")).alias("p0"))
    n = lambda g, name: counts.join(size.select("z", "cell"), ["z", "cell"], "left_semi").select("z", "cell", F.col("gene").alias(g), F.col("n").alias(name))
    met = s.select("cell", *PAIR).distinct()
    trials = met.join(n("g1", "n1"), ["cell", "g1"]).join(n("g2", "n2"), ["cell", "g2", "z"]).groupBy("cell", *PAIR).agg(F.sum(F.col("n1") * F.col("n2")).alias("trials"))
    return s.groupBy("cell", *PAIR).agg(F.sum("obs").alias("obs")).join(trials, ["cell", *PAIR]).join(p0, "cell").select("cell", *PAIR, "obs", "trials", "p0")


def edges(pp: DataFrame, alpha: float) -> DataFrame:
    return pp.where(F.col("pvalue") < alpha).drop("obs", "trials", "p0", "pvalue")


def conditional_global(e: DataFrame, counts: DataFrame, min_transcript: int = 0, eps: float = 1e-64, group: str | None = None, observed_only: bool = False) -> DataFrame:
    """Per pair (g1 <= g2): obs, expected and the chances' table: see conditional_chances."""
    c = conditional_chances(e, counts, min_transcript, eps, group, observed_only)
    keys = ([group] if group else []) + PAIR
    obs = e.groupBy(*keys).agg(F.count("*").alias("obs"))
    out = c.groupBy(*keys).agg(F.sum("p").alias("expected"), F.count("*").alias("n_cells"))
    return out.join(obs, keys, "left").fillna(0, ["obs"])


def conditional_chances(e: DataFrame, counts: DataFrame, min_transcript: int = 0, eps: float = 1e-64, group: str | None = None, observed_only: bool = False) -> DataFrame:
    """(g1, g2, cell, p): chance of an edge in each cell that has both genes above min_transcript.

    p = 1 - (1 - W / D) ** edges of the cell, W the product of the genes' degrees. D sums W over pairs i <= j whose row gene i
    is above min_transcript in the cell (the column gene need not be), so it rests on the order of gene names.
    observed_only leaves out pairs without any edge, whose p-value is 1.
    """
    gk = [group] if group else []
    ends = e.select(*gk, "cell", F.col("g1").alias("gene")).union(e.where("g1 <> g2").select(*gk, "cell", F.col("g2").alias("gene")))
    deg = ends.groupBy(*gk, "gene").agg(F.count("*").alias("deg"))
    genes = counts.select(*gk, "gene").distinct().join(deg, [*gk, "gene"], "left").fillna(0, ["deg"])
    w = Window.partitionBy(*gk).orderBy("gene").rowsBetween(0, Window.unboundedFollowing) if gk else Window.orderBy("gene").rowsBetween(0, Window.unboundedFollowing)
    genes = genes.withColumn("suffix", F.sum("deg").over(w))  # a table of genes, not of points
    present = counts.where(F.col("n") > min_transcript).join(genes, [*gk, "gene"]).select(*gk, "cell", "gene", "deg", "suffix")
    denom = present.groupBy(*gk, "cell").agg((F.sum((F.col("deg") * F.col("suffix")).cast("double")) + F.lit(eps)).alias("denom"))
    per_cell = e.groupBy(*gk, "cell").agg(F.count("*").alias("n_edges"))
    cells = denom.join(per_cell, [*gk, "cell"], "left").fillna(0, ["n_edges"])
    side = lambda g, d: present.select(*gk, "cell", F.col("gene").alias(g), F.col("deg").alias(d))
    if observed_only:
        met = e.select(*gk, *PAIR).distinct()
        both = met.join(side("g1", "d1"), [*gk, "g1"]).join(side("g2", "d2"), [*gk, "g2", "cell"])
    else:
        both = side("g1", "d1").join(side("g2", "d2"), [*gk, "cell"]).where("g1 <= g2")
    share = (F.col("d1") * F.col("d2")).cast("double") / F.col("denom")
    return both.join(cells, [*gk, "cell"]).select(*gk, *PAIR, "cell", (1 - F.pow(1 - share, F.col("n_edges"))).alias("p"))


def conditional_p_values(e: DataFrame, counts: DataFrame, min_transcript: int = 0, eps: float = 1e-64, group: str | None = None, chunk: int = 20_000, observed_only: bool = True) -> DataFrame:
    """Per pair: obs, expected, pvalue = P(X >= obs) for the sum of the cells' chances.

    Chances are cut into chunks by cell, so no task holds all cells of a pair. A pair's tilt comes from counts of its log-odds;
    each chunk gives the states of its tilted sum, and those of one pair are joined. See ``stats.poisson_binomial_tail``: the
    p-value is as accurate with many chunks as with one, however small it is, and the work is in proportion to the cells.
    """
    gk = [group] if group else []
    keys = gk + PAIR
    obs = e.groupBy(*keys).agg(F.count("*").alias("obs"))
    c = conditional_chances(e, counts, min_transcript, eps, group, observed_only)
    cells = counts.select("cell").distinct().count()
    salts = max(1, -(-cells // chunk))
    parts = c.withColumn("_s", F.pmod(F.xxhash64("cell"), F.lit(salts))).groupBy(*keys, "_s").agg(F.sum("p").alias("e"), F.sort_array(F.collect_list("p")).alias("p"))
    parts = store.stored(parts)
    kinds = ", ".join(f"`{k}` string" for k in keys)

    def odds(batches):
        for b in batches:
            rows = [_counted_odds(stats.log_odds(np.asarray(p))) for p in b["p"]]
            yield b[keys].assign(e=b["e"], cells=[len(p) for p in b["p"]], odds=[o for o, _ in rows], many=[m for _, m in rows])

    known = parts.mapInPandas(odds, f"{kinds}, e double, cells long, odds array<double>, many array<double>")
    known = known.groupBy(*keys).agg(F.sum("e").alias("expected"), F.sum("cells").alias("cells"), F.flatten(F.collect_list("odds")).alias("odds"), F.flatten(F.collect_list("many")).alias("many"))
    known = known.join(obs, keys, "left").fillna(0, ["obs"])

    def tilts(batches):
        for b in batches:
            found = [stats.tilt_for(int(k), np.asarray(o, float), np.asarray(m, float)) for k, o, m in zip(b["obs"], b["odds"], b["many"], strict=True)]
            yield b[[*keys, "obs", "expected"]].assign(tilt=pd.Series(found, dtype=float, index=b.index))

    total = known.mapInPandas(tilts, f"{kinds}, obs long, expected double, tilt double")

    def sums(batches):
        for b in batches:
            out = []
            for p, t in zip(b["p"], b["tilt"], strict=True):
                q, logs = stats.tilted(np.asarray(p), t)
                out.append((*stats.trial_sum(q), logs))
            yield b[[*keys, "obs", "expected", "tilt"]].assign(first=[f for f, _, _ in out], pmf=[x for _, x, _ in out], logs=[v for _, _, v in out])

    h = parts.drop("e", "_s").join(total, keys).mapInPandas(sums, f"{kinds}, obs long, expected double, tilt double, first long, pmf array<double>, logs double")
    h = h.groupBy(*keys).agg(*[F.max(x).alias(x) for x in ("obs", "expected", "tilt")], F.sort_array(F.collect_list(F.struct("first", "logs", "pmf"))).alias("parts"))

    def joined(batches):
        for b in batches:
            out = []
            for k, t, some in zip(b["obs"], b["tilt"], b["parts"], strict=True):
                first, pmf = stats.joined_states([(int(x["first"]), np.asarray(x["pmf"], float)) for x in some])
                out.append(1.0 if k <= 0 else stats.tilted_tail(int(k), first, pmf, float(t), float(sum(x["logs"] for x in some))))
            yield b[[*keys, "obs", "expected"]].assign(pvalue=pd.Series(out, dtype=float, index=b.index))

    return h.mapInPandas(joined, f"{kinds}, obs long, expected double, pvalue double")


def _counted_odds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of log-odds by eighths; the tilt that they give is off by far less than a deviation."""
    finite = np.isfinite(v)
    step, at = np.unique(np.floor(v[finite] * 8), return_inverse=True)
    count = np.bincount(at.ravel(), minlength=len(step)).astype(float)
    mean = np.bincount(at.ravel(), v[finite], minlength=len(step)) / np.maximum(count, 1)
    ends = [x for x in (-np.inf, np.inf) if (v == x).any()]
    return np.concatenate([mean, ends]), np.concatenate([count, [float((v == x).sum()) for x in ends]])


def significant(cpb: DataFrame, alpha: float) -> DataFrame:
    """Pairs of two different genes below alpha."""
    return cpb.where((F.col("pvalue") < alpha) & (F.col("g1") < F.col("g2")))


def all_pairs(cpb: DataFrame) -> DataFrame:
    """Pairs of different genes with -log10 of their p-value."""
    return cpb.where("g1 < g2").withColumn("neglog10_pvalue", stats.neglog10(F.col("pvalue")))


def present_cells(counts: DataFrame, min_transcript: int = 0) -> DataFrame:
    """(g1, g2, present): cells with both genes above min_transcript."""
    c = counts.where(F.col("n") > min_transcript)
    side = lambda g: c.select("cell", F.col("gene").alias(g))
    return side("g1").join(side("g2"), "cell").where("g1 <= g2").groupBy(*PAIR).agg(F.count("*").alias("present"))


def unstacked(cpb: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with the share of cells that have an edge among those that have both genes."""
    return cpb.join(present_cells(counts), PAIR).withColumn("frac_cells", F.col("obs") / F.col("present"))


def differential(e: DataFrame, counts: DataFrame, cells: DataFrame, wanted: str, rest: list[str] | None = None, column: str = "celltype", gate: float = 1e-3) -> DataFrame:
    """Per pair: is it colocalized in cells of one type more often than chance?

    uncond: hypergeometric tail of type cells among cells with the edge. marker: the same for cells that express the gene most
    (as many as there are type cells; ties by name). cond: given the overlap of both, where uncond <= gate, else uncond.
    ``rest`` names the types to compare with (all others by default). Each pair of two genes has two rows, (g1, g2) and
    (g2, g1): marker and cond are about cells that express the first gene of the row.
    """
    e = e.select("cell", *PAIR).union(e.where("g1 <> g2").select("cell", F.col("g2").alias("g1"), F.col("g1").alias("g2")))
    t = cells.select("cell", (F.col(column) == wanted).alias("mine"), F.col(column).alias("_t"))
    t = t.where(F.col("_t").isin([wanted, *rest])) if rest else t
    t = t.drop("_t").join(counts.select("cell").distinct(), "cell", "left_semi")
    sizes = t.agg(F.count("*").alias("total"), F.sum(F.col("mine").cast("long")).alias("m"))
    m = sizes.first()["m"] or 0
    ranked = counts.join(t, "cell").withColumn("_r", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "cell")))
    high = ranked.where(F.col("_r") <= m).select("gene", "cell", "mine")
    gamma = high.groupBy("gene").agg(F.sum(F.col("mine").cast("long")).alias("gamma"), F.count("*").alias("n1"))
    ee = e.join(t, "cell")
    hit = ee.join(high.select(F.col("gene").alias("g1"), "cell", F.lit(1).alias("hi")), ["g1", "cell"], "left")
    g = hit.groupBy(*PAIR).agg(F.count("*").alias("n2"), F.sum(F.col("mine").cast("long")).alias("lam"), F.sum(F.coalesce("hi", F.lit(0))).cast("long").alias("alpha"))
    g = g.join(gamma.withColumnRenamed("gene", "g1"), "g1").join(F.broadcast(sizes))
    g = g.withColumns({"uncond": stats.hypergeometric_tail_udf("lam", "total", "n2", "m"), "marker": stats.hypergeometric_tail_udf("gamma", "total", "n1", "m")})

    def cond(batches):
        for b in batches:
            b["cond"] = [u if u > gate else stats.conditional_tail(*map(int, x)) for u, *x in zip(b["uncond"], b["gamma"], b["lam"], b["alpha"], b["m"], b["n1"], b["n2"], b["total"], strict=True)]
            yield b

    cols = [*PAIR, "n2", "lam", "alpha", "gamma", "n1", "m", "total", "uncond", "marker"]
    return g.select(*cols).mapInPandas(cond, "g1 string, g2 string, n2 long, lam long, alpha long, gamma long, n1 long, m long, total long, uncond double, marker double, cond double")


def differential_all(e: DataFrame, counts: DataFrame, cells: DataFrame, column: str = "celltype", gate: float = 1e-3) -> DataFrame:
    """``differential`` of every type against all others, with the type as a column. Types are few; edges are read once each."""
    e, counts = store.stored(e), store.stored(counts)
    out = None
    for kind in sorted(x[0] for x in cells.select(column).distinct().collect() if x[0] is not None):
        one = differential(e, counts, cells, kind, None, column, gate).withColumn(column, F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def neighbour_frequency(e: DataFrame, cells: DataFrame, dist: float, min_neighbours: int = 1) -> DataFrame:
    """(g1, g2, cell, edge, freq): share of a cell's neighbours that have the edge, the global share where they are too few."""
    nb = joins.neighbour_cells(cells, dist)
    n = nb.groupBy("cell").agg(F.count("*").alias("n"))
    hits = nb.join(e.select(F.col("cell").alias("neighbour"), *PAIR), "neighbour").groupBy("cell", *PAIR).agg(F.count("*").alias("k"))
    total = cells.count()
    glob = e.groupBy(*PAIR).agg((F.count("*") / total).alias("p_global"))
    # every cell has a row for each pair that occurs: the fit needs the cells without the edge too
    base = cells.select("cell").join(n, "cell", "left").fillna(0, ["n"]).join(glob)
    out = base.join(hits, ["cell", *PAIR], "left").join(e.select("cell", *PAIR, F.lit(1).alias("edge")), ["cell", *PAIR], "left")
    return out.select(*PAIR, "cell", F.coalesce("edge", F.lit(0)).alias("edge"), "p_global", F.when(F.col("n") < min_neighbours, F.col("p_global")).otherwise(F.coalesce("k", F.lit(0)) / F.col("n")).alias("freq"))


def neighbour_counts(e: DataFrame, cells: DataFrame, dist: float, min_neighbours: int = 1) -> DataFrame:
    """(g1, g2, p_global, edge, freq, c): how many cells have (not) the edge and such a share of neighbours with it.

    The counts of ``neighbour_frequency`` without its table of cells x pairs: only cells that have the edge, or a neighbour with
    it, are looked at. The others of a pair have no edge and the share 0, or the global one where neighbours are too few, so
    their numbers are those of all cells by that test less what was counted.
    """
    e = store.stored(e.select("cell", *PAIR).distinct())
    nb = store.stored(joins.neighbour_cells(cells, dist))
    n = store.stored(cells.select("cell").distinct().join(nb.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0, ["n"]))
    few = F.col("n") < min_neighbours
    total, n_few = n.agg(F.count("*"), F.count_if(few)).first()
    glob = e.groupBy(*PAIR).agg((F.count("*") / F.lit(total)).alias("p_global"))
    hits = nb.join(e.withColumnRenamed("cell", "neighbour").hint("merge"), "neighbour").groupBy("cell", *PAIR).agg(F.count("*").alias("k"))
    seen = hits.join(e.withColumn("edge", F.lit(1)), ["cell", *PAIR], "full").join(n, "cell")
    seen = seen.select(*PAIR, F.coalesce("edge", F.lit(0)).alias("edge"), few.alias("few"), F.when(~few, F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 12)).alias("freq"))
    seen = store.stored(seen.groupBy(*PAIR, "edge", "few", "freq").agg(F.count("*").alias("c")))
    left = seen.groupBy(*PAIR).agg(F.sum(F.when(F.col("few"), F.col("c")).otherwise(0)).alias("f"), F.sum(F.when(F.col("few"), 0).otherwise(F.col("c"))).alias("m"))
    rest = left.select(*PAIR, F.lit(0).alias("edge"), F.explode(F.array(F.struct(F.lit(True).alias("few"), F.lit(None).cast("double").alias("freq"), (F.lit(n_few) - F.col("f")).alias("c")), F.struct(F.lit(False).alias("few"), F.lit(0.0).alias("freq"), (F.lit(total - n_few) - F.col("m")).alias("c")))).alias("r"))
    both = seen.select(*PAIR, "edge", "few", "freq", "c").unionByName(rest.select(*PAIR, "edge", "r.few", "r.freq", "r.c").where("c > 0"))
    both = both.join(glob, PAIR)
    return both.groupBy(*PAIR, "p_global", "edge", F.when(F.col("few"), F.round("p_global", 12)).otherwise(F.col("freq")).alias("freq")).agg(F.sum("c").alias("c"))


def spatial_modulation(freq: DataFrame) -> DataFrame:
    """Per pair: log-likelihood ratio of edges given the neighbours' share against a constant chance, and the fitted (w, p1).

    Takes ``neighbour_counts``, or the rows of ``neighbour_frequency``, which are counted first; so a task's group has distinct
    values, not cells.
    """
    g = freq if "c" in freq.columns else freq.groupBy(*PAIR, "p_global", "edge", F.round("freq", 12).alias("freq")).agg(F.count("*").alias("c"))

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        edge, f, c = d["edge"].to_numpy(), d["freq"].to_numpy(), d["c"].to_numpy(float)
        p0 = float(d["p_global"].iloc[0])
        lo, hi = 1e-5, 1 - 1e-5

        def ll(w, p):
            t = p * (1 - w) + w * f
            with np.errstate(divide="ignore"):
                return float((c * np.log(np.where(edge == 1, t, 1 - t))).sum())

        k = (c * edge).sum()
        q = min(max(p0, 1e-64), 1.0)
        h0 = float(k * np.log(q) + ((c.sum() - k) * np.log1p(-q) if q < 1 else 0.0))
        ws, ps = np.linspace(lo, hi, 25), np.linspace(lo, hi, 25)
        best = max(((ll(w, p), w, p) for w in (lo, *ws) for p in (min(max(p0, lo), hi), *ps)), key=lambda x: x[0])
        step = 0.04
        while step > 1e-7:  # concave in (w * p, w): a pattern search settles
            tries = [(min(max(best[1] + a * step, lo), hi), min(max(best[2] + b * step, lo), hi)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            top = max(((ll(w, p), w, p) for w, p in tries), key=lambda x: x[0])
            if top[0] > best[0] + 1e-12:
                best = top
            else:
                step /= 2
        return pd.DataFrame({"g1": [d["g1"].iloc[0]], "g2": [d["g2"].iloc[0]], "llr": [best[0] - h0], "w_h1": [best[1]], "p_h1": [best[2]], "p_global": [p0]})

    g = g.repartition(FITS, *PAIR)  # few rows a pair, but each fit takes long, so tasks don't follow bytes
    return g.groupBy(*PAIR).applyInPandas(fit, "g1 string, g2 string, llr double, w_h1 double, p_h1 double, p_global double")


def _among(df: DataFrame, good: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose values are among the good ones, which are counted: every task gets them only if they are few."""
    few = good.limit(HELD + 1).count() <= HELD
    return df.join(F.broadcast(good) if few else good.hint("merge"), on, "left_semi")


def modules(e: DataFrame, size: int = 3, support: int = 5) -> DataFrame:
    """(genes, support): sets of genes that are all joined with one another in at least ``support`` cells.

    Grown a gene at a time from frequent smaller sets (a set can't be frequent if a part isn't), in name order. A set carries the
    later genes that are joined with all of its own, so each step is one join by cell and gene. A written table's file is far smaller
    than its rows, so its size must not decide that it is sent to every task: such joins go by key.
    """
    pairs = e.where("g1 < g2 AND cell IS NOT NULL").groupBy("cell", "g1").agg(F.collect_set("g2").alias("later"))
    pairs = store.stored(pairs)  # read at every step
    pairs = pairs.select("cell", "g1", F.explode("later").alias("g2"))
    frequent = pairs.groupBy(*PAIR).agg(F.count("*").alias("s")).where(F.col("s") >= support).drop("s")
    pairs = _among(pairs, store.stored(frequent), PAIR)
    if size <= 2:
        return pairs.groupBy(F.array(*PAIR).alias("genes")).agg(F.count("*").alias("support"))
    beside = pairs.groupBy("cell", "g1").agg(F.collect_set("g2").alias("later"))
    sets = beside.select("cell", F.array("g1").alias("genes"), "later")
    for k in range(2, size):
        grown = sets.where(F.size("later") > size - k).withColumn("g1", F.explode("later"))
        grown = grown.join(beside.withColumnRenamed("later", "_l").hint("merge"), ["cell", "g1"])
        sets = grown.select("cell", F.array_append("genes", F.col("g1")).alias("genes"), F.array_intersect("later", "_l").alias("later"))
        sets = sets.where(F.size("later") >= size - k)  # others can't get all their genes any more
        if k > 2:
            sets = store.stored(sets)
            ok = sets.groupBy("genes").agg(F.count("*").alias("s")).where(F.col("s") >= support).drop("s")
            sets = _among(sets, store.stored(ok), ["genes"])
    last = sets.select("genes", F.explode("later").alias("new"))
    return last.groupBy(F.array_append("genes", F.col("new")).alias("genes")).agg(F.count("*").alias("support")).where(F.col("support") >= support)


def subgraphs(e: DataFrame, n_vertices: int, n_edges: int, support: int = 5) -> DataFrame:
    """(genes, edges, support): connected graphs of genes with so many vertices and edges that ``support`` cells have in full.

    A gene is one vertex of a cell's graph, so a graph is its set of edges and its sorted edge list its code. Grown an edge at a
    time from the edges at its genes: every connected graph has an edge without which it is connected, and a graph is no more
    frequent than its parts, so none is missed. A code that is reached in several ways is kept once a cell. Graphs that can't
    get all their vertices any more, or have too many, are not grown.
    """
    if not 1 <= n_vertices - 1 <= n_edges <= n_vertices * (n_vertices - 1) // 2:
        raise ValueError(f"no connected graph has {n_vertices} vertices and {n_edges} edges")
    pairs = e.where("g1 < g2").select("cell", F.struct("g1", "g2").alias("edge")).distinct()

    def frequent(df: DataFrame, code: str) -> DataFrame:
        ok = df.groupBy(code).agg(F.count("*").alias("s")).where(F.col("s") >= support).drop("s")
        return df.join(ok, code, "left_semi")

    pairs = store.stored(frequent(pairs, "edge"))
    end = lambda a, b: F.struct(F.col(f"edge.{a}").alias("gene"), F.col(f"edge.{b}").alias("other"))
    at_gene = pairs.select("cell", F.explode(F.array(end("g1", "g2"), end("g2", "g1"))).alias("end"), "edge").select("cell", "end.gene", "end.other", "edge")
    found = pairs.select("cell", F.array("edge").alias("code"), F.array("edge.g1", "edge.g2").alias("genes"))
    for k in range(2, n_edges + 1):
        grown = found.select("cell", "code", "genes", F.explode("genes").alias("gene")).join(at_gene.hint("merge"), ["cell", "gene"]).where(~F.array_contains("code", F.col("edge")))
        # an edge between two genes that are there comes from both: one is enough; arrays are built for what goes on only
        within = F.array_contains("genes", F.col("other"))
        size = F.size("genes") + F.when(within, 0).otherwise(1)
        grown = grown.where((~within | (F.col("gene") < F.col("other"))) & (size <= n_vertices) & (size + n_edges - k >= n_vertices))
        genes = F.array_sort(F.array_union("genes", F.array("other")))
        grown = grown.select("cell", F.array_sort(F.array_append("code", F.col("edge"))).alias("code"), genes.alias("genes")).distinct()
        last, found = found, store.stored(frequent(grown, "code"))
        if k > 2:
            store.released(last)
    named = F.transform("code", lambda x: F.concat(x["g1"], F.lit("--"), x["g2"]))
    out = found.groupBy("code", "genes").agg(F.count("*").alias("support")).where((F.col("support") >= support) & (F.size("genes") == n_vertices))
    return out.select("genes", named.alias("edges"), "support")
