"""Quality filters ahead of all features. Each is a join or a window; none collects rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from ..sources.bundle import Bundle
from . import geometry

QUANTILES = (0.01, 0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975, 0.99)
FUNNEL = ("n_cells", "n_genes", "n_transcripts", "n_cell_gene_pairs")


def nc_ratio(vertices: DataFrame) -> DataFrame:
    """(cell, cell_area, nucleus_area, nc_ratio) of cells with both outlines."""
    a = geometry.closed_rings(vertices).select("cell", "kind", geometry.area(F.col("segs")).alias("area"))
    both = a.groupBy("cell").agg(F.max(F.when(F.col("kind") == "cell", F.col("area"))).alias("cell_area"), F.max(F.when(F.col("kind") == "nucleus", F.col("area"))).alias("nucleus_area"))
    return both.dropna().withColumn("nc_ratio", F.col("nucleus_area") / F.col("cell_area"))


def nc_ratio_cells(vertices: DataFrame, low: float = 0.025, high: float = 0.975, min_cells: int = 10) -> DataFrame | None:
    """Cells between two exact quantiles of the ratio; None where fewer than min_cells would stay (then nothing is filtered)."""
    r = nc_ratio(vertices).where("nc_ratio > 0 and nc_ratio < 1")
    limits = r.agg(F.percentile("nc_ratio", F.array(F.lit(low), F.lit(high))).alias("q"))
    kept = r.join(F.broadcast(limits), (F.col("nc_ratio") >= F.col("q")[0]) & (F.col("nc_ratio") <= F.col("q")[1])).select("cell", "nc_ratio")
    return kept if len(kept.take(min_cells)) >= min_cells else None


def min_transcripts(tx: DataFrame, k: int = 6) -> DataFrame:
    """Rows of (cell, gene) pairs with k rows or more."""
    ok = tx.groupBy("cell", "gene").count().where(F.col("count") >= k).select("cell", "gene")
    return tx.join(ok, ["cell", "gene"], "left_semi")


def min_cells_of_gene(tx: DataFrame, k: int = 10) -> DataFrame:
    """Rows of genes that are in k cells or more."""
    ok = tx.select("cell", "gene").distinct().groupBy("gene").count().where(F.col("count") >= k).select("gene")
    return tx.join(ok, "gene", "left_semi")


def synchronize(b: Bundle) -> Bundle:
    """Keep the cells that all tables have. Nuclei count only where there are any."""
    tx, v = b.transcripts, b.vertices
    ids = v.where("kind = 'cell'").select("cell").distinct()
    nuclei = v.where("kind = 'nucleus'").select("cell").distinct()
    if nuclei.take(1):
        ids = ids.join(nuclei, "cell", "left_semi")
    tx = tx.join(ids, "cell", "left_semi")
    seen = tx.select("cell").distinct()
    return replace(b, transcripts=tx, vertices=v.join(seen, "cell", "left_semi"), cells=None if b.cells is None else b.cells.join(seen, "cell", "left_semi"))


def first_cells(tx: DataFrame, n: int, by: str = "tx_id") -> DataFrame:
    """Rows of the n cells that appear first: by the least value of a column that tells the rows' order, then by name."""
    first = tx.groupBy("cell").agg(F.min(by).alias("_first")).orderBy("_first", "cell").limit(n).select("cell")
    return tx.join(first, "cell", "left_semi")


def subset_cells(b: Bundle, cells: DataFrame) -> Bundle:
    keep = lambda df: df.join(cells.select("cell"), "cell", "left_semi")
    return Bundle(keep(b.transcripts), keep(b.vertices), None if b.cells is None else keep(b.cells))


def stats(tx: DataFrame, stage: str = "") -> DataFrame:
    """One row: stage and the four funnel counts. Counts of pairs come first, so one shuffle of pairs does for all."""
    return _funnel(tx.groupBy("cell", "gene").agg(F.count("*").alias("n")), stage)


def _funnel(pairs: DataFrame, stage: str) -> DataFrame:
    """The counts of a stage from its table (cell, gene, n)."""
    counts = (F.count_distinct("cell").alias("n_cells"), F.count_distinct("gene").alias("n_genes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_transcripts"), F.count("*").alias("n_cell_gene_pairs"))
    return pairs.agg(*counts).select(F.lit(stage).alias("stage"), *FUNNEL)


def boundary_counts(vertices: DataFrame, stage: str = "") -> DataFrame:
    """One row: stage and how many cells have an outline, a nucleus' outline, and both."""
    by = vertices.groupBy("cell").agg(F.max((F.col("kind") == "cell").cast("int")).alias("c"), F.max((F.col("kind") == "nucleus").cast("int")).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(total("c").alias("n_cell_boundary"), total("n").alias("n_nuclear_boundary"), total(F.col("c") * F.col("n")).alias("n_both")).select(F.lit(stage).alias("stage"), "*")


def distributions(b: Bundle, stage: str = "") -> DataFrame:
    """How four numbers are distributed: transcripts of a (cell, gene), transcripts and genes of a cell, cells of a gene, and the
    nc_ratio of cells with both outlines.

    (stage, measure, n, mean, sd, min, max, q_0.01 .. q_0.99): sd is that of a sample, null for one value; quantiles are exact
    and interpolated. A measure without values has no row. The points are grouped once; no task sorts a column.
    """
    from .compartment import exact_quantiles

    pairs = store.stored(b.transcripts.groupBy("cell", "gene").agg(F.count("*").alias("n")))
    cells = pairs.groupBy("cell").agg(F.sum("n").alias("t"), F.count("*").alias("g"))
    long = pairs.select(F.lit("transcripts_per_pair").alias("measure"), F.col("n").cast("double").alias("value"))
    long = long.unionByName(cells.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).cast("double").alias("value")) for k, c in (("transcripts_per_cell", "t"), ("genes_per_cell", "g"))])).alias("r")).select("r.*"))
    long = long.unionByName(pairs.groupBy("gene").agg(F.count("*").cast("double").alias("value")).select(F.lit("cells_per_gene").alias("measure"), "value"))
    long = store.stored(long.unionByName(nc_ratio(b.vertices).select(F.lit("nc_ratio").alias("measure"), F.col("nc_ratio").alias("value"))))
    v = F.col("value")
    g = long.where(v.isNotNull()).groupBy("measure").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(long, "value", list(QUANTILES), "measure")
    return g.join(q, "measure").select(F.lit(stage).alias("stage"), "measure", "n", "mean", "sd", "min", "max", *[F.col("q")[i].alias(f"q_{x}") for i, x in enumerate(QUANTILES)])


def nc_ratio_report(vertices: DataFrame, low: float = 0.025, high: float = 0.975, min_cells: int = 10, target: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """One row: what ``nc_ratio_cells`` does and to how many cells.

    status is filtered, or skipped where fewer than min_cells would stay (then all cells that have a ratio in (0, 1) count as
    left); the two quantiles; mean and median before and after; is the mean after within the target range?
    """
    r = store.stored(nc_ratio(vertices).where("nc_ratio > 0 and nc_ratio < 1").select("nc_ratio"))
    x = F.col("nc_ratio")
    said = lambda d, when: d.agg(F.count("*").alias(f"n_{when}"), F.avg(x).alias(f"mean_{when}"), F.percentile(x, F.lit(0.5)).alias(f"median_{when}"))
    ends = r.agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("q")).select(F.col("q")[0].alias("low_value"), F.col("q")[1].alias("high_value"))
    inside = r.join(F.broadcast(ends), (x >= F.col("low_value")) & (x <= F.col("high_value"))).select("nc_ratio")
    filtered = len(inside.take(min_cells)) >= min_cells
    one = said(r, "before").join(F.broadcast(ends)).join(F.broadcast(said(inside if filtered else r, "after")))  # three tables of one row
    return one.select(F.lit("filtered" if filtered else "skipped").alias("status"), "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), "low_value", "high_value", "mean_before", "mean_after", "median_before", "median_after", F.col("mean_after").between(*target).alias("mean_in_target"))


def prefilter(b: Bundle, k_transcripts: int = 6, k_cells: int = 10, q_low: float = 0.025, q_high: float = 0.975, min_cells: int = 10) -> tuple[Bundle, DataFrame]:
    """The filters in their fixed order and the table of counts after each.

    All of them judge whole (cell, gene) pairs, so they run on the table of pair counts, written once; the points are read
    twice: to be counted, and to be joined with the pairs that are left.
    """
    pairs = store.stored(b.transcripts.groupBy("cell", "gene").agg(F.count("*").alias("n")))
    stages = [("0_input", pairs)]
    cells = nc_ratio_cells(b.vertices, q_low, q_high, min_cells)
    left = pairs if cells is None else pairs.join(cells.select("cell"), "cell", "left_semi")
    stages.append(("1_nc_ratio", left))
    left = left.where(F.col("n") >= k_transcripts)
    stages.append(("2_cell_gene", left))
    often = left.groupBy("gene").agg(F.count("*").alias("_c")).where(F.col("_c") >= k_cells).select("gene")
    left = left.join(often, "gene", "left_semi")
    stages.append(("3_gene", left))
    known = b.vertices.where("kind = 'cell'").select("cell").distinct()
    nuclei = b.vertices.where("kind = 'nucleus'").select("cell").distinct()
    known = known.join(nuclei, "cell", "left_semi") if nuclei.take(1) else known
    left = store.stored(left.join(known, "cell", "left_semi"))
    stages.append(("4_synchronized", left))
    report = None
    for name, table in stages:
        one = _funnel(table, name)
        report = one if report is None else report.unionByName(one)
    seen = left.select("cell").distinct()
    keep = lambda df: None if df is None else df.join(seen, "cell", "left_semi")
    return Bundle(b.transcripts.join(left.select("cell", "gene"), ["cell", "gene"], "left_semi"), keep(b.vertices), keep(b.cells)), report


def top_genes(tx: DataFrame, n_genes: int, n_spots: int | None = None) -> DataFrame:
    """Rows of each cell's n_genes most frequent genes, at most n_spots rows of each (by tx_id)."""
    counts = tx.groupBy("cell", "gene").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("cell").orderBy(F.desc("_n"), "gene")
    out = tx.join(counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_genes).select("cell", "gene"), ["cell", "gene"], "left_semi")
    if n_spots is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("cell", "gene").orderBy("tx_id"))).where(F.col("_r") <= n_spots).drop("_r")


def genes_by_count(tx: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows of (cell, gene) pairs with a count in [low, high]."""
    c = F.count("*").over(Window.partitionBy("cell", "gene"))
    cond = (F.col("_n") >= low) if high is None else F.col("_n").between(low, high)
    return tx.withColumn("_n", c).where(cond).drop("_n")


def cells_above(tx: DataFrame, threshold: int) -> DataFrame:
    """Rows of cells with more than threshold rows."""
    return tx.join(tx.groupBy("cell").count().where(F.col("count") > threshold).select("cell"), "cell", "left_semi")


def frequent_genes(tx: DataFrame, n: int = 100) -> DataFrame:
    """Rows of the n most frequent genes."""
    return tx.join(tx.groupBy("gene").count().orderBy(F.desc("count"), "gene").limit(n).select("gene"), "gene", "left_semi")


def random_cells(tx: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows of n cells chosen by a hash of the name."""
    ids = tx.select("cell").distinct().orderBy(F.xxhash64(F.lit(seed), "cell"), "cell").limit(n)
    return tx.join(ids, "cell", "left_semi")


def allocated(sizes: DataFrame, target: int) -> DataFrame:
    """(stratum, share) from (stratum, size): proportional shares of target, never above the size.

    By largest remainders: a stratum's places are one at least (if target allows one each), then its whole share, then one more
    in the order of the remainders; the first ``target`` places in this order are filled. One window over places says it all,
    and there are at most ``target`` + twice the number of strata of them.
    """
    whole = Window.partitionBy(F.lit(0))
    s = sizes.where("size > 0").withColumns({"_all": F.sum("size").over(whole), "_k": F.count("*").over(whole)})
    s = s.withColumn("_want", F.least(F.lit(target).cast("long"), F.col("_all"))).withColumn("_exact", F.col("size") * F.col("_want") / F.col("_all"))
    place = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("size"), F.floor("_exact").cast("long") + 1)))
    p = s.select("*", place.alias("_place"))
    rest = F.col("_exact") - F.floor("_exact")
    turn = F.when((F.col("_place") == 1) & (F.col("_want") >= F.col("_k")), 0).when(F.col("_place") <= F.col("_exact"), 1).otherwise(2)
    order = Window.partitionBy(F.lit(0)).orderBy(turn, F.when(turn == 2, -rest).otherwise(-(F.col("_exact") - F.col("_place"))), "stratum")
    got = p.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_want")).groupBy("stratum").agg(F.count("*").alias("share"))
    return s.select("stratum").join(got, "stratum", "left").fillna(0, ["share"])


def sample_cells(tx: DataFrame, cells: DataFrame | None = None, n: int | None = None, fraction: float | None = None, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """(cell, stratum) of sampled cells: n of them or a fraction, by strata if asked for. The choice is by hash, so repeatable.

    Only the number of cells reaches the driver.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    ids = tx.select("cell").distinct()
    if stratum is None:
        ids = ids.withColumn("stratum", F.lit("all"))
    else:
        source = cells if cells is not None and stratum in cells.columns else tx
        if stratum not in source.columns:
            raise ValueError(f"no column {stratum}")
        ids = ids.join(source.groupBy("cell").agg(F.min(F.col(stratum).cast("string")).alias("stratum")), "cell", "left").withColumn("stratum", F.coalesce("stratum", F.lit("__missing__")))
    sizes = ids.groupBy("stratum").agg(F.count("*").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    share = allocated(sizes, max(1, min(total, n if n is not None else round(total * fraction))))
    w = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), "cell"), "cell")
    return ids.withColumn("_r", F.row_number().over(w)).join(F.broadcast(share), "stratum").where(F.col("_r") <= F.col("share")).select("cell", "stratum")


def clean_p(df: DataFrame, column: str = "pvalue") -> DataFrame:
    """Keeps the raw value; the cleaned one is 1 where missing and lies in [0, 1]."""
    p = F.col(column)
    return df.withColumns({f"{column}_raw": p, column: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(p), p), F.lit(1.0))))})
