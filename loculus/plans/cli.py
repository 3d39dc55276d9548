"""Commands: features, patterns, run, compartments, coloc, regions, summary, views, report. ``python -m loculus.plans.cli <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compartment
from ..sources import results
from ..sources.bundle import read_bundle, read_table, save_table
from . import pipelines


def _prefilter_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--no-prefilter", action="store_true")
    p.add_argument("--nc-ratio-q-low", type=float, default=0.025)
    p.add_argument("--nc-ratio-q-high", type=float, default=0.975)
    p.add_argument("--cellgene-filter-min-transcripts", type=int, default=6)
    p.add_argument("--gene-filter-min-cells", type=int, default=10)
    p.add_argument("--max-cells", type=int)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loculus")
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features", help="features of each cell and gene")
    f.add_argument("bundle")
    f.add_argument("out")
    f.add_argument("--iterations", type=int, default=200)
    f.add_argument("--pairs", type=int, default=4)
    f.add_argument("--fast", action="store_true", help="50 cells, 20 iterations, 2 pairs")
    _prefilter_flags(f)
    w = sub.add_parser("run", help="features of each cell and gene, then patterns")
    for x in ("bundle", "out", "model"):
        w.add_argument(x)
    w.add_argument("--fallback-model")
    w.add_argument("--foci-fallback-threshold", type=float, default=0.5)
    w.add_argument("--iterations", type=int, default=200)
    w.add_argument("--pairs", type=int, default=4)
    _prefilter_flags(w)
    p = sub.add_parser("patterns", help="patterns from a feature table")
    for a in ("features", "out", "model"):
        p.add_argument(a)
    p.add_argument("--fallback-model")
    p.add_argument("--foci-fallback-threshold", type=float, default=0.5)
    c = sub.add_parser("compartments", help="subdomains of points")
    c.add_argument("bundle")
    c.add_argument("out")
    c.add_argument("--group-col", default="batch")
    c.add_argument("--only-groups", help="comma-separated")
    c.add_argument("--frac", type=float, default=0.01)
    c.add_argument("--radius", type=float, default=40.0)
    c.add_argument("--n-clusters", type=int)
    c.add_argument("--same-cell-neighborhood", action="store_true")
    c.add_argument("--reports", help="a folder for batches (JSON, a folder a group) and a catalog")
    k = sub.add_parser("coloc", help="colocalized gene pairs")
    k.add_argument("bundle")
    k.add_argument("out")
    for name, kind, default in (("distance", float, 4.0), ("pp-alpha", float, 1e-3), ("cpb-alpha", float, 1e-4), ("min-genecount", int, 20), ("sample-random-state", int, 42)):
        k.add_argument(f"--{name}", type=kind, default=default)
    k.add_argument("--use-2d", action="store_true")
    k.add_argument("--groupby")
    k.add_argument("--sample-cells", type=int)
    k.add_argument("--sample-cell-frac", type=float)
    k.add_argument("--sample-stratify-by")
    k.add_argument("--precision-mode", choices=("high", "low"), default="high")
    k.add_argument("--region-threshold-mode", choices=("cell_scaled", "fixed"), default="cell_scaled")
    k.add_argument("--save-by-cell", action="store_true")
    k.add_argument("--save-matrices", action="store_true", help="also counts by cell and gene, pairs by cell, and all pairs with their p-values; as sparse tables")
    _prefilter_flags(k)
    g = sub.add_parser("regions", help="regions of given pairs (table with gene_1, gene_2)")
    for a in ("bundle", "pairs", "out"):
        g.add_argument(a)
    g.add_argument("--distance", type=float, default=4.0)
    g.add_argument("--sampled-cells", help="a text file of cells, one a line; the others are left out")
    g.add_argument("--groupby", help="a column of cells; each group has its own pairs (the table's rows of that group), points and sizes")
    _prefilter_flags(g)
    g.add_argument("--region-threshold-mode", choices=("cell_scaled", "fixed"), default="cell_scaled")
    s = sub.add_parser("summary", help="compare pairs across a context column")
    s.add_argument("table", help="a table of pairs, a folder of runs, or with --metadata a table of dataset and result_dir")
    s.add_argument("--metadata", action="store_true")
    s.add_argument("--pairs-name", default="pairs.parquet")
    s.add_argument("--regions-name", default="regions.parquet")
    s.add_argument("out")
    s.add_argument("--context", default="group")
    s.add_argument("--top-n", type=int, default=50)
    s.add_argument("--min-shared-groups", type=int, default=2)
    s.add_argument("--region-consistency-threshold", type=float, default=0.8)
    v = sub.add_parser("views", help="tables behind the pictures of a table of pairs")
    v.add_argument("table")
    v.add_argument("out")
    v.add_argument("--bundle", help="with --pair: the points that the run was made of")
    v.add_argument("--pair", nargs=2, metavar="GENE", help="example cells, links and points of these two genes too")
    v.add_argument("--distance", type=float, default=4.0)
    v.add_argument("--viz-top-genes", type=int, default=80)
    v.add_argument("--viz-top-edges", type=int, default=80)
    e = sub.add_parser("report", help="what a bundle holds before and after the prefilter")
    e.add_argument("bundle")
    e.add_argument("out")
    _prefilter_flags(e)
    return top


def _contexts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    names = {"pairs": a.pairs_name, "regions": a.regions_name}
    if a.metadata:
        return results.read_metadata(spark, a.table, **names)
    if results.run_folders(spark, a.table, a.pairs_name):
        return results.read_runs(spark, a.table, **names)
    return read_table(spark, a.table)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"loculus {a.command}").getOrCreate()
    pre = None
    if hasattr(a, "no_prefilter") and not a.no_prefilter:
        pre = pipelines.Prefilter(a.nc_ratio_q_low, a.nc_ratio_q_high, a.cellgene_filter_min_transcripts, a.gene_filter_min_cells)
    if a.command == "features":
        it, pairs, cells = (20, 2, 50) if a.fast else (a.iterations, a.pairs, a.max_cells)
        save_table(pipelines.feature_table(read_bundle(spark, a.bundle), it, pairs, pre, cells), a.out)
    elif a.command == "run":
        table, found = pipelines.features_and_patterns(read_bundle(spark, a.bundle), a.model, a.fallback_model, a.foci_fallback_threshold, a.iterations, a.pairs, pre, a.max_cells)
        paths = {"features": save_table(table, f"{a.out}/features"), "patterns": save_table(found, f"{a.out}/patterns")}
        results.save_catalog(spark, paths, f"{a.out}/catalog.json")
    elif a.command == "views":
        folder = results.exists(spark, f"{a.table}/pairs.parquet")
        tables = pipelines.view_tables(read_table(spark, f"{a.table}/pairs.parquet" if folder else a.table), a.viz_top_genes, a.viz_top_edges)
        if a.pair:
            if not a.bundle:
                raise SystemExit("--pair needs --bundle")
            known = read_table(spark, f"{a.table}/by_cell.parquet") if folder and results.exists(spark, f"{a.table}/by_cell.parquet") else None
            tables |= pipelines.pair_views(read_bundle(spark, a.bundle), *a.pair, a.distance, known)
        paths = {name: save_table(df, f"{a.out}/{name}") for name, df in tables.items()}
        results.save_catalog(spark, paths, f"{a.out}/catalog.json")
    elif a.command == "patterns":
        save_table(pipelines.patterns(read_table(spark, a.features), a.model, a.fallback_model, a.foci_fallback_threshold), a.out)
    elif a.command == "compartments":
        only = a.only_groups.split(",") if a.only_groups else None
        at = save_table(pipelines.compartments(read_bundle(spark, a.bundle), a.frac, a.radius, a.group_col, only, a.same_cell_neighborhood, a.n_clusters), a.out)
        if a.reports:
            found = compartment.group_report(read_table(spark, at), a.group_col)
            found.write.mode("overwrite").partitionBy(a.group_col).json(f"{a.reports}/batches")
            results.save_catalog(spark, {"points": at}, f"{a.reports}/catalog.json")
    elif a.command == "report":
        for name, df in pipelines.report(read_bundle(spark, a.bundle), pre or pipelines.Prefilter()).items():
            save_table(df, f"{a.out}/{name}")
    elif a.command == "coloc":
        r = pipelines.colocalization(read_bundle(spark, a.bundle), a.distance, a.pp_alpha, a.cpb_alpha, a.min_genecount, a.use_2d, a.groupby, pre, a.max_cells, a.sample_cells, a.sample_cell_frac, a.sample_stratify_by, a.sample_random_state, a.precision_mode, a.region_threshold_mode == "cell_scaled")
        tables = {"pairs": r.pairs, "prefilter": r.prefilter, "sample": r.sample, "regions": r.regions, "by_cell": r.by_cell if a.save_by_cell or a.save_matrices else None}
        if a.save_matrices:
            tables |= {"gene_counts": r.counts, "all_pairs": r.all_pairs}
        for name, df in tables.items():
            if df is not None:
                save_table(df, f"{a.out}/{name}")
    elif a.command == "regions":
        keys = [a.groupby] if a.groupby else []
        pairs = read_table(spark, a.pairs).select(*keys, F.least("gene_1", "gene_2").alias("g1"), F.greatest("gene_1", "gene_2").alias("g2")).distinct()
        b, _ = pipelines.prepared(read_bundle(spark, a.bundle), pre, None)
        if a.sampled_cells:
            b = pipelines.prefilter.subset_cells(b, results.read_cells(spark, a.sampled_cells))
        save_table(pipelines.pair_regions(b, pairs, a.distance, scaled=a.region_threshold_mode == "cell_scaled", group=a.groupby), a.out)
    else:
        for name, df in pipelines.context_tables(_contexts(spark, a), a.context, a.top_n, a.min_shared_groups, a.region_consistency_threshold).items():
            save_table(df, f"{a.out}/{name}")


if __name__ == "__main__":
    main()
