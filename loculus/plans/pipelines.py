"""Whole queries from a bundle to written tables. Groups are key columns, so a run over groups is one job, not one a group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, coloc, compartment, features, geometry, prefilter, region, summary, views
from ..sources import bundle as bundles
from ..sources import store
from ..sources.bundle import Bundle


@dataclass(frozen=True)
class Prefilter:
    q_low: float = 0.025
    q_high: float = 0.975
    min_transcripts: int = 6
    min_cells: int = 10


def prepared(b: Bundle, pre: Prefilter | None = Prefilter(), max_cells: int | None = None) -> tuple[Bundle, DataFrame | None]:
    b = b.with_transcripts(bundles.preprocess(b.transcripts))
    report = None
    if pre is not None:
        b, report = prefilter.prefilter(b, pre.min_transcripts, pre.min_cells, pre.q_low, pre.q_high)
    return (b if max_cells is None else b.with_transcripts(prefilter.first_cells(b.transcripts, max_cells))), report


def feature_table(b: Bundle, iterations: int = 200, pairs: int = 4, pre: Prefilter | None = Prefilter(), max_cells: int | None = None) -> DataFrame:
    b, _ = prepared(b, pre, max_cells)
    return features.feature_table(b.transcripts, geometry.shape_table(geometry.closed_rings(b.vertices)), iterations, pairs)


def patterns(table: DataFrame, model_path: str, fallback_path: str | None = None, threshold: float = 0.5) -> DataFrame:
    load = classify.PatternModel.load
    return classify.predict_with_fallback(store.stored(table), load(model_path), (lambda: load(fallback_path)) if fallback_path else None, threshold)


def features_and_patterns(b: Bundle, model_path: str, fallback_path: str | None = None, threshold: float = 0.5, iterations: int = 200, pairs: int = 4, pre: Prefilter | None = Prefilter(), max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The feature table, written once, and the patterns predicted from it."""
    table = store.stored(feature_table(b, iterations, pairs, pre, max_cells))
    return table, patterns(table, model_path, fallback_path, threshold)


@dataclass(frozen=True)
class Colocalization:
    pairs: DataFrame
    by_cell: DataFrame
    prefilter: DataFrame | None
    sample: DataFrame | None
    regions: DataFrame | None
    counts: DataFrame | None = None
    all_pairs: DataFrame | None = None


def colocalization(b: Bundle, distance: float = 4.0, pp_alpha: float = 1e-3, cpb_alpha: float = 1e-4, min_genecount: int = 20, use_2d: bool = False, group: str | None = None, pre: Prefilter | None = Prefilter(), max_cells: int | None = None,
                   sample_cells: int | None = None, sample_fraction: float | None = None, stratum: str | None = None, seed: int = 42, precision: str = "high", scaled: bool = True, with_regions: bool = True) -> Colocalization:
    """Significant gene pairs with their counts, and their regions where there are nuclei; each by group if there is one."""
    b, report = prepared(b, pre, max_cells)
    sample = None
    if sample_cells is not None or sample_fraction is not None:
        sample = prefilter.sample_cells(b.transcripts, b.cells, sample_cells, sample_fraction, seed, stratum)
        b = prefilter.subset_cells(b, sample)
    tx = bundles.attach(b.transcripts, b.cells, group).where(F.col(group).isNotNull()) if group else b.transcripts
    dims = ("x", "y", "z") if "z" in tx.columns and not use_2d else ("x", "y")
    tx = store.stored(tx)
    pp = store.stored(coloc.proximal_pairs(tx, distance, min_genecount, group, dims))
    e = coloc.edges(pp, pp_alpha)
    counts = store.stored(coloc.gene_counts(tx, ([group] if group else []) + ["cell"]))
    cpb = coloc.conditional_p_values(e, counts, 0, 1e-64 if precision == "high" else 1e-16, group)
    cpb = store.stored(prefilter.clean_p(cpb))
    sig = coloc.significant(cpb, cpb_alpha)
    out = sig.select(*([group] if group else []), F.col("g1").alias("gene_1"), F.col("g2").alias("gene_2"), F.col("pvalue").alias("cpb_pvalue"), F.col("pvalue_raw").alias("cpb_pvalue_raw"), F.col("expected").alias("expected_coloc"), F.lit(distance).alias("distance_threshold"), F.lit(pp_alpha).alias("pp_alpha"), F.lit(cpb_alpha).alias("cpb_alpha"), F.col("obs").alias("n_cells_pp_significant"), F.col("obs").alias("n_cells"))
    regions = None
    if with_regions:
        regions = pair_regions(b.with_transcripts(tx), store.stored(sig.select(*([group] if group else []), "g1", "g2")), distance, dims, scaled, group)
    return Colocalization(out, pp, report, sample, regions, counts, cpb)


def pair_regions(b: Bundle, pairs: DataFrame, distance: float = 4.0, dims: tuple[str, ...] = ("x", "y"), scaled: bool = True, group: str | None = None) -> DataFrame:
    """Regions of the pairs; with a group, of each group's own pairs, points and median sizes."""
    s = geometry.shape_table(geometry.closed_rings(b.vertices))
    tx, keys, sized = b.transcripts, [], s
    if group:
        tx, keys = bundles.attach(tx, b.cells, group).where(F.col(group).isNotNull()), [group]
        sized = s.join(tx.select(group, "cell").distinct(), "cell")
    t = region.thresholds(sized, scaled, group)
    labelled = region.labels(features.placed(tx, s, t, [*keys, "cell"]))
    return region.enrichment(region.pair_regions(labelled, distance, pairs, dims, keys), region.background(s, t, group=group), group)


def annotated_pairs(r: Colocalization, group: str) -> DataFrame:
    """The pairs of a grouped run with their regions ('none' without close pairs), as context_tables takes them."""
    named = r.regions.withColumnsRenamed({"g1": "gene_1", "g2": "gene_2"})
    return with_regions(r.pairs.join(named, [group, "gene_1", "gene_2"], "left"))


def with_regions(df: DataFrame) -> DataFrame:
    """Pairs with all columns of regions: 0 and 'none' where a pair has none, or the run was made without them."""
    numbers = ["n_proximal_pairs", *[f"{k}_enrichment" for k in region.REGIONS], "dominant_enrichment_score", "second_enrichment_score"]
    names = ["dominant_region", "second_region"]
    df = df.withColumns({c: F.lit(None).cast("double") for c in numbers if c not in df.columns} | {c: F.lit(None).cast("string") for c in names if c not in df.columns})
    return df.fillna(0, numbers).fillna("none", names)


def view_tables(pairs: DataFrame, genes: int = 80, edges: int = 80) -> dict[str, DataFrame]:
    """Tables behind the pictures of a run's pairs: heatmap, network (its largest component), degrees and components."""
    cpb = store.stored(pairs.select(F.least("gene_1", "gene_2").alias("g1"), F.greatest("gene_1", "gene_2").alias("g2"), F.col("cpb_pvalue").alias("pvalue")))
    net = store.stored(views.network(cpb, edges))
    return {"heatmap": views.heatmap(cpb, genes), "network": views.largest_component(net), "degrees": views.degrees(net), "components": views.components(net)}


def pair_views(b: Bundle, gene_1: str, gene_2: str, distance: float = 4.0, by_cell: DataFrame | None = None, cells: int = 6) -> dict[str, DataFrame]:
    """Tables behind the pictures of one pair: cells to look at, and in these the links and all points of the two genes.

    ``by_cell`` is a run's own table of pairs by cell; without it, it is worked out for the two genes' cells.
    """
    tx = bundles.preprocess(b.transcripts)
    if by_cell is None:
        both = tx.where(F.col("gene") == gene_1).select("cell").distinct().join(tx.where(F.col("gene") == gene_2).select("cell").distinct(), "cell")
        by_cell = coloc.proximal_pairs(tx.join(both, "cell", "left_semi"), distance)
    chosen = store.stored(views.example_cells(by_cell, tx, gene_1, gene_2, distance, cells))
    seen = tx.where(F.col("gene").isin(gene_1, gene_2)).join(F.broadcast(chosen.select("cell")), "cell", "left_semi")  # a few cells
    return {"example_cells": chosen, "links": views.links(seen, gene_1, gene_2, distance), "points": seen}


def report(b: Bundle, pre: Prefilter = Prefilter()) -> dict[str, DataFrame]:
    """What a bundle holds before and after the prefilter: counts by stage, outlines, distributions, the filter of ratios."""
    raw = b.with_transcripts(bundles.preprocess(b.transcripts))
    left, funnel = prefilter.prefilter(raw, pre.min_transcripts, pre.min_cells, pre.q_low, pre.q_high)
    both = lambda of: of(raw, "raw").unionByName(of(left, "final"))
    return {
        "funnel": funnel, "boundaries": both(lambda x, stage: prefilter.boundary_counts(x.vertices, stage)),
        "distributions": both(prefilter.distributions), "nc_ratio": prefilter.nc_ratio_report(raw.vertices, pre.q_low, pre.q_high),
    }


def compartments(b: Bundle, fraction: float = 0.01, radius: float = 40.0, group: str = "batch", only: list[str] | None = None, same_cell: bool = False, clusters: int | None = None) -> DataFrame:
    tx = bundles.attach(bundles.preprocess(b.transcripts), b.cells, group, "batch0")
    if only is not None:
        known = {r[0] for r in tx.select(group).distinct().collect()}
        if missing := set(only) - known:
            raise ValueError(f"no such groups: {', '.join(sorted(missing))}")
        tx = tx.where(F.col(group).isin(only))
    return compartment.compartments(tx, fraction, radius, group, same_cell, clusters)


def context_tables(df: DataFrame, context: str = "group", top: int = 50, min_shared: int = 2, consistency: float = 0.8) -> dict[str, DataFrame]:
    """All comparison tables of pairs across contexts, by name."""
    df = summary.with_pair(with_regions(df))
    contexts = sorted(str(r[0]) for r in df.select(context).distinct().collect() if r[0] is not None)
    s = summary.pair_context_summary(df, context)
    return {
        "presence_matrix": summary.presence_matrix(df, context, contexts), "overlaps": summary.overlaps(df, context), "region_distribution": summary.region_distribution(df, context), "gene_hubs": summary.gene_hubs(df, context),
        "pair_summary": s, "classes": summary.classes(s, min_shared, consistency), "overview": summary.context_overview(df, context), "top_pairs": summary.top_pairs(df, context, top),
    }
