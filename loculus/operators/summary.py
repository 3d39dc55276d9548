"""Comparison of colocalized pairs across contexts: groups of one data set, or data sets.

Tables have pair, gene_1, gene_2, a context column and, where known, cpb_pvalue, dominant_region, its score and counts.
Ties are broken by name, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .region import REGIONS


def with_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("pair", F.concat_ws("--", F.least("gene_1", "gene_2"), F.greatest("gene_1", "gene_2")))


def join_unique(c: str):
    return F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ";")


def presence_matrix(df: DataFrame, context: str, contexts: list[str]) -> DataFrame:
    """A 0/1 column for each context; the contexts are given, so no job looks for them."""
    return df.groupBy("pair").pivot(context, contexts).agg(F.max(F.lit(1))).fillna(0)


def presence_with_genes(df: DataFrame, context: str, contexts: list[str]) -> DataFrame:
    """The presence matrix with the two genes of each pair."""
    genes = df.groupBy("pair").agg(F.min(F.least("gene_1", "gene_2")).alias("gene_1"), F.max(F.greatest("gene_1", "gene_2")).alias("gene_2"))
    return genes.join(presence_matrix(df, context, contexts), "pair", "right")


def overlaps(df: DataFrame, context: str) -> DataFrame:
    """(context_1, context_2, n_shared, n_union, jaccard) for context_1 <= context_2."""
    d = df.select("pair", F.col(context).alias("c")).distinct()
    n = d.groupBy("c").agg(F.count("*").alias("n"))
    shared = d.withColumnRenamed("c", "a").join(d.withColumnRenamed("c", "b"), "pair").where("a <= b").groupBy("a", "b").agg(F.count("*").alias("s"))
    grid = n.select(F.col("c").alias("a"), F.col("n").alias("na")).join(n.select(F.col("c").alias("b"), F.col("n").alias("nb")), F.col("a") <= F.col("b"))
    g = grid.join(shared, ["a", "b"], "left").fillna(0, ["s"])
    union = F.col("na") + F.col("nb") - F.col("s")
    return g.select(F.col("a").alias("context_1"), F.col("b").alias("context_2"), F.col("s").alias("n_shared"), union.alias("n_union"), (F.col("s") / union).alias("jaccard"))


def region_distribution(df: DataFrame, context: str) -> DataFrame:
    g = df.groupBy(context, F.coalesce("dominant_region", F.lit("unannotated")).alias("dominant_region")).agg(F.count("*").alias("n_pairs"))
    return g.withColumn("fraction", F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy(context)))


def region_enrichment_long(df: DataFrame, ids: list[str]) -> DataFrame:
    cols = [f"{r}_enrichment" for r in REGIONS if f"{r}_enrichment" in df.columns]
    return df.unpivot(ids, cols, "m", "enrichment").select(*ids, F.replace("m", F.lit("_enrichment"), F.lit("")).alias("region"), "enrichment")


def _regions(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, consensus_region, n_regions, region_counts, region_consistency), 'none' and nulls aside."""
    c = df.where(F.col("dominant_region").isNotNull() & (F.col("dominant_region") != "none")).groupBy(*keys, "dominant_region").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("dominant_region").alias("r"))))
    g = c.groupBy(*keys).agg(s.alias("s"), F.sum("n").alias("t"))
    said = F.array_join(F.transform("s", lambda x: F.concat(x["r"], F.lit(":"), (-x["k"]).cast("string"))), ";")
    return g.select(*keys, F.col("s")[0]["r"].alias("consensus_region"), F.size("s").alias("n_dominant_regions"), said.alias("region_counts"), (-F.col("s")[0]["k"] / F.col("t")).alias("region_consistency"))


def gene_hubs(df: DataFrame, context: str | None = None) -> DataFrame:
    """Per gene (and context): number of distinct pairs, regions of its pairs' rows, least p-value."""
    keys = ([context] if context else []) + ["gene"]
    both = df.withColumn("gene", F.explode(F.array_distinct(F.array("gene_1", "gene_2"))))
    deg = both.groupBy(*keys).agg(F.count_distinct("pair").alias("degree"), F.min("cpb_pvalue").alias("best_cpb_pvalue"))
    reg = _regions(both, keys).select(*keys, F.col("consensus_region").alias("top_region"), "region_counts")
    return deg.join(reg, keys, "left").fillna({"top_region": "none", "region_counts": ""})


def pair_context_summary(df: DataFrame, context: str) -> DataFrame:
    """Per pair: contexts it is in, is it specific, shared or ubiquitous, its regions, and extremes of its statistics."""
    n_all = df.agg(F.count_distinct(context).alias("n_all"))
    named = df.withColumn("_c", F.col(context).cast("string"))
    g = named.groupBy("pair").agg(
        F.min("gene_1").alias("gene_1"), F.min("gene_2").alias("gene_2"), F.count_distinct("_c").alias("n_contexts"), F.array_join(F.array_sort(F.collect_set("_c")), ";").alias("contexts"),
        F.min("cpb_pvalue").alias("min_cpb_pvalue"), F.percentile("cpb_pvalue", F.lit(0.5)).alias("median_cpb_pvalue"), F.max(F.when(F.col("cpb_pvalue") > 0, -F.log10("cpb_pvalue"))).alias("max_neglog10_cpb"),
        F.max("n_cells").alias("max_n_cells"), F.sum("n_cells").alias("sum_n_cells"), F.max("n_proximal_pairs").alias("max_n_proximal_pairs"), F.sum("n_proximal_pairs").alias("sum_n_proximal_pairs"),
        F.max("dominant_enrichment_score").alias("max_score"), F.avg("dominant_enrichment_score").alias("mean_score"),
    )
    g = g.join(F.broadcast(n_all)).join(_regions(df, ["pair"]), "pair", "left").fillna({"consensus_region": "none", "n_dominant_regions": 0, "region_counts": ""})
    one, all_ = F.col("n_contexts") == 1, F.col("n_contexts") == F.col("n_all")
    return g.select(
        "pair", "gene_1", "gene_2", "n_contexts", "contexts", (F.col("n_contexts") / F.col("n_all")).alias("presence_fraction"), one.alias("is_specific"), F.when(one, F.col("contexts")).otherwise("").alias("specific_context"),
        (F.col("n_contexts") >= 2).alias("is_shared"), all_.alias("is_ubiquitous"), "consensus_region", "region_consistency", "n_dominant_regions", "region_counts",
        F.coalesce(F.col("region_consistency") == 1.0, F.lit(False)).alias("is_region_consistent"), (F.col("n_dominant_regions") > 1).alias("is_region_shifted"),
        "min_cpb_pvalue", "median_cpb_pvalue", "max_neglog10_cpb", "max_n_cells", "sum_n_cells", "max_n_proximal_pairs", "sum_n_proximal_pairs", "max_score", "mean_score",
    )


def context_overview(df: DataFrame, context: str) -> DataFrame:
    genes = df.select(context, F.explode(F.array("gene_1", "gene_2")).alias("gene")).groupBy(context).agg(F.count_distinct("gene").alias("n_genes_in_pairs"))
    p = df.dropDuplicates([context, "pair"])
    g = p.groupBy(context).agg(
        F.count("*").alias("n_pairs"), F.min("cpb_pvalue").alias("min_cpb_pvalue"), F.percentile("cpb_pvalue", F.lit(0.5)).alias("median_cpb_pvalue"),
        F.count_if(F.col("cpb_pvalue") < 1e-4).alias("n_pairs_cpb_lt_1e_4"), F.count_if(F.col("cpb_pvalue") < 1e-6).alias("n_pairs_cpb_lt_1e_6"), F.percentile("n_cells", F.lit(0.5)).alias("median_n_cells"), F.max("n_cells").alias("max_n_cells"),
    )
    named = p.withColumn("dominant_region", F.coalesce("dominant_region", F.lit("unannotated")))
    r = _regions(named, [context]).select(context, F.col("consensus_region").alias("top_dominant_region"), F.col("region_counts").alias("dominant_region_counts"))
    return g.join(genes, context).join(r, context, "left")


def top_pairs(df: DataFrame, context: str, n: int = 50, by: str = "cpb_pvalue", ascending: bool = True) -> DataFrame:
    w = Window.partitionBy(context).orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), "pair")
    return df.withColumn("rank_in_context", F.row_number().over(w)).where(F.col("rank_in_context") <= n)


def region_specific_pairs(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows with a region, by region and descending score."""
    return df.where(F.col("dominant_region").isNotNull()).select("dominant_region", *ids, "dominant_enrichment_score", "cpb_pvalue", "n_proximal_pairs").orderBy("dominant_region", F.desc("dominant_enrichment_score"), "pair")


def classes(summary: DataFrame, min_shared: int = 2, consistency: float = 0.8) -> DataFrame:
    """(class, pair): specific, shared, ubiquitous, region_consistent, region_shifted; a pair may be in several."""
    tests = {"specific": F.col("is_specific"), "shared": F.col("n_contexts") >= min_shared, "ubiquitous": F.col("is_ubiquitous"), "region_consistent": (F.col("n_contexts") >= min_shared) & (F.col("region_consistency") >= consistency), "region_shifted": F.col("is_region_shifted")}
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return summary.select(F.explode(named).alias("class"), "pair")


def conserved(df: DataFrame, within: str | None = None, min_datasets: int = 2, consistency: float = 0.8) -> DataFrame:
    """Pairs in at least min_datasets data sets (within each value of a column, e.g. species or tissue, if given)."""
    keys = ([within] if within else []) + ["pair"]
    g = df.groupBy(*keys).agg(F.count_distinct("dataset").alias("n_datasets"), F.array_join(F.array_sort(F.collect_set("dataset")), ";").alias("datasets")).where(F.col("n_datasets") >= min_datasets)
    r = _regions(df, keys).select(*keys, "consensus_region", "region_consistency")
    return g.join(r, keys, "left").withColumn("is_region_conserved", F.coalesce(F.col("region_consistency") >= consistency, F.lit(False)))
