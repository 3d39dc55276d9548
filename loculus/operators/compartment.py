"""Compartments: local composition around sampled points, its embedding, and a one-row map of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import interpolation, joins, whole

MILLION = 1_000_000


def sample_points(tx: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose hash falls below the fraction: the same rows in every run."""
    return tx.where(F.pmod(F.xxhash64(F.lit(seed), "cell", "tx_id"), F.lit(MILLION)) < int(fraction * MILLION))


def _near(samples: DataFrame, tx: DataFrame, radius: float, keys: list[str], limit: int, write: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """``whole.near_genes`` of keys that fit a task, ``_spread_composition`` of the others, if there are any, and the points, which
    are written first unless ``write`` is off."""
    cols = list(dict.fromkeys([*keys, "cell", "tx_id", "x", "y", "gene"]))
    if samples is tx:
        rows = tx.select(*cols, F.lit(2).alias("_kind"))
    else:
        rows = tx.select(*cols, F.lit(0).alias("_kind")).unionByName(samples.select(*cols, F.lit(1).alias("_kind")))
    rows = whole.stored(rows) if write else rows
    small, large = whole.parted(rows, keys, limit, write)
    ids = list(dict.fromkeys([*keys, "cell", "tx_id"]))
    spread = None if large is None else _spread_composition(large.where("_kind > 0"), large.where("_kind <> 1"), radius, keys)
    return whole.near_genes(small, keys, ids, radius, "_kind"), spread, rows.where("_kind <> 1")


def local_composition(samples: DataFrame, tx: DataFrame, radius: float, keys: list[str], limit: int = whole.LIMIT) -> DataFrame:
    """(keys, cell, tx_id, gene, n, total): genes within the radius of each sampled point. keys says what may be near.

    Keys of at most ``limit`` points are worked on in a task each, so points are sent once and rows of the result never. Points that
    are their own samples are read once besides the count of their keys, so they are not written either, and not sent at all if
    they lie by key.
    """
    near, spread, _ = _near(samples, tx, radius, keys, limit, write=samples is not tx)
    out = near.where("n > 0").select(*[k for k in keys if k != "cell"], "cell", "tx_id", "gene", "n", "total")
    return out if spread is None else out.unionByName(spread)


def _spread_composition(samples: DataFrame, tx: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    a = samples.select(*dict.fromkeys([*keys, "cell", "tx_id", "x", "y"]))
    b = tx.select(*dict.fromkeys([*keys, "gene", "x", "y"]))
    key = [F.col(k) for k in keys]
    left = a.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("cell", "tx_id")], "x", "y")
    near = joins.radius_join(left, b, radius, keys)
    g = near.groupBy(*key, F.col("a.s_cell").alias("_cell"), F.col("a.s_tx_id").alias("tx_id"), F.col("b.gene").alias("gene")).agg(F.count("*").alias("n"))
    total = g.groupBy(*keys, "_cell", "tx_id").agg(F.sum("n").alias("total"))
    out = g.join(total, [*keys, "_cell", "tx_id"])
    extra = [k for k in keys if k != "cell"]
    return out.select(*extra, F.col("_cell").alias("cell"), "tx_id", "gene", "n", "total")


def cell_composition(tx: DataFrame, group: str | None = None) -> DataFrame:
    """(group, cell, gene, f): share of each gene among a cell's points."""
    keys = [*([group] if group else []), "cell"]
    g = tx.groupBy(*keys, "gene").agg(F.count("*").alias("n"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("t"))
    return g.join(t, keys).select(*keys, "gene", (F.col("n") / F.col("t")).alias("f"))


def gene_spread(f: DataFrame, group: str | None = None) -> DataFrame:
    """(group, gene, sd): population standard deviation of the share over all cells (of the group), absent ones as 0; genes
    without spread are left out."""
    keys = [group] if group else []
    cells = f.groupBy(*keys).agg(F.count_distinct("cell").alias("c"))
    g = f.groupBy(*keys, "gene").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"))
    g = g.join(cells, keys) if keys else g.join(F.broadcast(cells))
    var = F.col("q") / F.col("c") - (F.col("s") / F.col("c")) * (F.col("s") / F.col("c"))
    return g.select(*keys, "gene", F.sqrt(F.greatest(F.lit(0.0), var)).alias("sd")).where("sd > 1e-12")


def flux(local: DataFrame, tx: DataFrame, group: str | None = None) -> DataFrame:
    """(group, cell, tx_id, gene, value): (local share - own cell's share) / spread (in the group), for genes in either."""
    keys = [*([group] if group else []), "cell"]
    f = cell_composition(tx, group)
    pts = local.select(*keys, "tx_id").distinct()
    own = pts.join(f, keys)
    near = local.select(*keys, "tx_id", "gene", (F.col("n") / F.col("total")).alias("l"))
    both = own.join(near, [*keys, "tx_id", "gene"], "full")
    spread = gene_spread(f, group)
    value = (F.coalesce("l", F.lit(0.0)) - F.coalesce("f", F.lit(0.0))) / F.col("sd")
    return both.join(spread, [*([group] if group else []), "gene"]).select(*keys, "tx_id", "gene", value.alias("value"))


def local_flux(samples: DataFrame, tx: DataFrame, radius: float, keys: list[str], group: str | None = None, limit: int = whole.LIMIT) -> DataFrame:
    """``flux`` of ``local_composition``. Where neighbours are those of the own cell, the task that counts them has the cell's shares
    too, so no row of the result is sent on; the spread, one row a gene (and group), is broadcast."""
    own = [*([group] if group else []), "cell"]
    if set(keys) != set(own):
        return flux(local_composition(samples, tx, radius, keys, limit), tx, group)
    near, spread, tx = _near(samples, tx, radius, keys, limit)
    sd = F.broadcast(gene_spread(cell_composition(tx, group), group))
    value = (F.col("n") / F.col("total") - F.col("own") / F.col("size")) / F.col("sd")
    out = near.join(sd, [*([group] if group else []), "gene"]).select(*own, "tx_id", "gene", value.alias("value"))
    return out if spread is None else out.unionByName(flux(spread, tx, group))


def loadings(rows: list[tuple[str, str, float]], k: int) -> list[tuple]:
    """(gene, v1, ..., vk): leading eigenvectors of a symmetric table (gene, gene, value); each one's largest loading is positive."""
    genes = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {g: i for i, g in enumerate(genes)}
    m = np.zeros((len(genes), len(genes)))
    for a, b, v in rows:
        m[at[a], at[b]] = m[at[b], at[a]] = v
    vec = np.linalg.eigh(m)[1][:, ::-1][:, :k]
    vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])] < 0, -1, 1)
    vec = np.c_[vec, np.zeros((len(genes), k - vec.shape[1]))]
    return [(g, *row) for g, row in zip(genes, vec.tolist(), strict=True)]


def embed(values: DataFrame, k: int = 3, group: str | None = None) -> DataFrame:
    """(group, cell, tx_id, e1..ek): projection on the k leading right singular vectors (of the group), no centring.

    The genes x genes matrix of products is aggregated in Spark; one task per group holds it (genes squared, whatever the number
    of points) and gives the vectors, one row a gene. Nothing reaches the driver.
    """
    keys = [group] if group else []
    pts = [*keys, "cell", "tx_id"]
    v = values.withColumn("_g", F.lit(0)) if not keys else values.withColumn("_g", F.col(group))
    a, b = v.select("_g", *pts, F.col("gene").alias("g1"), F.col("value").alias("_a")), v.select(*pts, F.col("gene").alias("g2"), F.col("value").alias("_b"))
    gram = a.join(b, pts).where("g1 <= g2").groupBy("_g", "g1", "g2").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    kind = v.schema["_g"].dataType.simpleString()
    names = [f"v{i}" for i in range(1, k + 1)]

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(loadings(list(zip(d["g1"], d["g2"], d["v"], strict=True)), k), columns=["gene", *names])
        out.insert(0, "_g", d["_g"].iloc[0])
        return out

    load = gram.groupBy("_g").applyInPandas(fit, f"_g {kind}, gene string, " + ", ".join(f"{n} double" for n in names))
    return v.join(load, ["_g", "gene"]).groupBy(*pts).agg(*[F.sum(F.col("value") * F.col(n)).alias(f"e{n[1:]}") for n in names])


def exact_quantiles(df: DataFrame, column: str, shares: list[float], group: str | None = None, buckets: int = 1024) -> DataFrame:
    """(group, q): interpolated exact quantiles of a column, as an array in the order of the shares.

    Two passes: values are counted in buckets between the extremes, so the bucket of each wanted rank is known; only values of
    those buckets are then ranked. No task sorts the whole column. Null values are left out;
    without any other the quantiles are null (one row without a group, none with one).
    """
    keys = [group] if group else []
    d = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    ends = d.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    with_ends = (lambda x: x.join(F.broadcast(ends), keys)) if keys else (lambda x: x.join(F.broadcast(ends)))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))).otherwise(0).cast("int")
    placed = with_ends(d).withColumn("b", bucket)
    sizes = placed.groupBy(*keys, "b").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    before = sizes.withColumn("end", F.sum("c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("b")))  # one row a bucket
    ranks = F.array(*[F.struct(F.floor(s * (F.col("n") - 1)).alias("r"), F.ceil(s * (F.col("n") - 1)).alias("t")) for s in map(F.lit, shares)])
    hit = F.exists(ranks, lambda x: ((x["r"] < F.col("end")) & (x["r"] >= F.col("end") - F.col("c"))) | ((x["t"] < F.col("end")) & (x["t"] >= F.col("end") - F.col("c"))))
    wanted = before.where(hit).select(*keys, "b", (F.col("end") - F.col("c")).alias("skip"))
    near = placed.join(F.broadcast(wanted), [*keys, "b"]).withColumn("rank", F.col("skip") + F.row_number().over(Window.partitionBy(*keys, "b").orderBy("v")) - 1)
    ends_of = [F.max(F.when(F.col("rank") == f(F.lit(s) * (F.col("n") - 1)), F.col("v"))) for s in shares for f in (F.floor, F.ceil)]
    g = near.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*ends_of).alias("e"))
    part = lambda i, s: F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
    return g.select(*keys, F.array(*[F.col("e")[2 * i] + part(i, s) * (F.col("e")[2 * i + 1] - F.col("e")[2 * i]) for i, s in enumerate(shares)]).alias("q"))


def quantile_normalize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, group: str | None = None) -> DataFrame:
    """Each column between its two quantiles (of the group) to [0.1, 0.9], the order reversed; 0.5 where they are equal."""
    out = df
    for c in columns:
        q = exact_quantiles(df, c, [low, high], group).withColumnRenamed("q", "_q")
        out = out.join(F.broadcast(q), group, "left") if group else out.join(F.broadcast(q), how="left")
        lo, hi = F.col("_q")[0], F.col("_q")[1]
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo)))
        out = out.withColumn(c, F.when(hi > lo, 0.9 - 0.8 * unit).otherwise(0.5)).drop("_q")
    return out


def fit_map(x: np.ndarray, k: int, iterations: int = 1000, sigma: float = 1.0, rate: float = 0.5, seed: int = 42) -> np.ndarray:
    """Weights of a self-organizing map of 1 x k nodes; both widths decay over the iterations."""
    rng = np.random.default_rng(seed)
    w = x[rng.choice(len(x), k, replace=len(x) < k)].astype(float).copy()
    order = rng.integers(0, len(x), iterations)
    grid = np.arange(k)
    for t, i in enumerate(order):
        fade = 1 / (1 + 2 * t / iterations)
        best = int(((w - x[i]) ** 2).sum(axis=1).argmin())
        pull = rate * fade * np.exp(-((grid - best) ** 2) / (2 * (sigma * fade) ** 2))
        w += pull[:, None] * (x[i] - w)
    return w


def elbow(errors: dict[int, float]) -> int:
    """The number of nodes whose error lies farthest below the line between the ends; fails where none does."""
    ks = sorted(errors)
    if len(ks) < 3:
        raise ValueError("elbow: too few sizes")
    span, drop = ks[-1] - ks[0], errors[ks[0]] - errors[ks[-1]]
    gain = {k: (errors[ks[0]] - errors[k]) / drop - (k - ks[0]) / span for k in ks} if drop > 0 else {}
    best = max(gain, key=lambda k: (gain[k], -k), default=None)
    if best is None or gain[best] <= 0:
        raise ValueError("elbow: no bend in the errors")
    return best


def fitted(x: np.ndarray, k: int | None, sizes: range, iterations: int, seed: int) -> np.ndarray:
    """Nodes of a map of k of them, or of as many as the elbow of the errors says."""
    if k is not None:
        return fit_map(x, k, iterations, seed=seed)
    fits = {s: fit_map(x, s, iterations, seed=seed) for s in sizes}
    return fits[elbow({s: float(np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2)).min(axis=1).mean()) for s, w in fits.items()})]


def subdomains(values: DataFrame, columns: list[str], k: int | None = None, sizes: range = range(2, 13), max_rows: int = 20_000, iterations: int = 1000, seed: int = 42, group: str | None = None) -> DataFrame:
    """Adds subdomain: the nearest node of a map (of the group) that was fitted on about max_rows rows at most, chosen by hash.

    A map of 1000 steps sees at most 1000 rows, so the bound loses nothing that the fit would use. Each group's map is fitted
    in one task on its bounded sample; assignment covers every row with column expressions. A group whose map can't be fitted
    (no rows, no elbow) has null subdomains, and ``status`` tables say why.
    """
    keys = [group] if group else []
    h = F.xxhash64(F.lit(seed), "cell", "tx_id")
    sizes_of = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = values.join(F.broadcast(sizes_of), keys) if keys else values.join(F.broadcast(sizes_of))
    part = part.where(F.pmod(h, F.lit(MILLION)) < F.ceil(F.lit(max_rows * MILLION) / F.col("_n"))).withColumn("_h", h)
    part = part.withColumn("_g", F.col(group) if group else F.lit(0))
    kind = part.schema["_g"].dataType.simpleString()

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["_h", *columns])
        try:
            w, said = fitted(d[columns].to_numpy(float)[:max_rows], k, sizes, iterations, seed).tolist(), "done"
        except ValueError as problem:
            w, said = [], f"failed: {problem}"
        return pd.DataFrame({"_g": [d["_g"].iloc[0]], "nodes": [w], "status": [said]})

    maps = part.select("_g", "_h", *columns).groupBy("_g").applyInPandas(fit, f"_g {kind}, nodes array<array<double>>, status string")
    v = values.withColumn("_g", F.col(group) if group else F.lit(0)).join(F.broadcast(maps), "_g", "left")
    far = lambda w: sum(((F.col(c) - w[i]) * (F.col(c) - w[i]) for i, c in enumerate(columns)), F.lit(0.0))
    nearest = F.array_min(F.transform("nodes", lambda w, i: F.struct(far(w).alias("d"), i.alias("i"))))["i"]
    return v.withColumn("subdomain", nearest).drop("_g", "nodes")


def compartments(tx: DataFrame, fraction: float = 0.01, radius: float = 40.0, group: str = "batch", same_cell: bool = False, k: int | None = None) -> DataFrame:
    """Point table: group, cell, tx_id, all other columns of tx, e1..e3 (normalized), subdomain and status for all points.

    Every step is by group: neighbourhoods, spread, vectors, quantiles and map. A group that fails leaves the others as they are.
    Values between samples are linear over their triangulation, in each cell by itself with ``same_cell``.
    """
    keys = [group] + (["cell"] if same_cell else [])
    s = sample_points(tx, fraction)
    e = store.stored(embed(local_flux(s, tx, radius, keys, group), 3, group))
    e = quantile_normalize(e, ["e1", "e2", "e3"], group=group)
    at = e.join(s.select(group, "cell", "tx_id", "x", "y"), [group, "cell", "tx_id"])
    values = interpolation.linear(at, tx, ["e1", "e2", "e3"], keys, ["cell", "tx_id"] if not same_cell else ["tx_id"], nearest=same_cell)
    out = subdomains(store.stored(values), ["e1", "e2", "e3"], k, group=group)
    return tx.join(out, [group, "cell", "tx_id"])


def group_status(points: DataFrame, group: str = "batch") -> DataFrame:
    """(group, status, n_points, n_cells, n_subdomains) of a point table."""
    return points.groupBy(group).agg(F.first("status").alias("status"), F.count("*").alias("n_points"), F.count_distinct("cell").alias("n_cells"), F.count_distinct("subdomain").alias("n_subdomains"))


def group_report(points: DataFrame, group: str = "batch") -> DataFrame:
    """(group, status, n_points, n_cells, n_subdomains, sizes): ``group_status`` with the number of points by subdomain, as a map
    from its number; points without one count nowhere."""
    by = points.where(F.col("subdomain").isNotNull()).groupBy(group, "subdomain").agg(F.count("*").alias("n"))
    sizes = by.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("subdomain").cast("string"), "n")))).alias("sizes"))  # a row a node
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:bigint>>"))
    status, sizes = group_status(points, group), sizes.withColumnRenamed(group, "_g")
    return status.join(sizes, status[group].eqNullSafe(sizes["_g"]), "left").drop("_g").withColumn("sizes", F.coalesce("sizes", empty))
