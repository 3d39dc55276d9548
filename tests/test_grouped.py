"""A run over groups against a run on each group's cells alone, and the summaries of its output."""

import pytest
from test_engine import TX, VERTS, points, square

from loculus.plans import pipelines
from loculus.sources.bundle import Bundle

GROUPS = {"c0": "a", "c1": "a", "c2": "b", "c3": "b", "c4": None}


def test_regions_of_a_grouped_run(spark):
    tx = points(60, 5, 3)
    verts = [v for i, c in enumerate(GROUPS) for v in square(c, "cell", -1.0, 13.0 + 2 * i) + square(c, "nucleus", 3.0, 8.0 + i)]

    def run(cells, group):
        b = Bundle(
            spark.createDataFrame([t for t in tx if t[0] in cells], TX).coalesce(1), spark.createDataFrame([v for v in verts if v[0] in cells], VERTS).coalesce(1),
            spark.createDataFrame([(c, GROUPS[c]) for c in cells], "cell string, kind_of_cell string").coalesce(1),
        )
        return pipelines.colocalization(b, 2.0, 2.0, 2.0, 1, group=group, pre=None)

    whole = run(list(GROUPS), "kind_of_cell")
    pairs = pipelines.annotated_pairs(whole, "kind_of_cell").persist()
    scores = lambda r: tuple(pytest.approx(r[f"{k}_enrichment"]) for k in pipelines.region.REGIONS)
    got = {(r.kind_of_cell, r.gene_1, r.gene_2): (r.n_proximal_pairs, r.dominant_region, scores(r)) for r in pairs.collect()}
    want = {}
    for g in ("a", "b"):
        alone = run([c for c, x in GROUPS.items() if x == g], None)
        want |= {(g, r.g1, r.g2): (r.n_proximal_pairs, r.dominant_region, tuple(r[f"{k}_enrichment"] for k in pipelines.region.REGIONS)) for r in alone.regions.collect()}
    assert len(want) == 6 and got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want)
    tables = pipelines.context_tables(pairs, "kind_of_cell")
    assert {r.kind_of_cell: r.n_pairs for r in tables["overview"].collect()} == {"a": 3, "b": 3}
    assert {(r.pair, r.n_contexts) for r in tables["pair_summary"].collect()} == {(f"{a}--{b}", 2) for _, a, b in want}


def test_summary_of_the_files_of_a_grouped_run(spark, tmp_path):
    """The two commands in a row: each group's pairs have that group's regions, and all eight tables come out."""
    from loculus.plans import cli
    from loculus.sources import results
    from loculus.sources.bundle import Bundle, save_bundle

    verts = [v for i, c in enumerate(GROUPS) for v in square(c, "cell", -1.0, 13.0 + 2 * i) + square(c, "nucleus", 3.0, 8.0 + i)]
    cells = spark.createDataFrame(list(GROUPS.items()), "cell string, batch string")
    save_bundle(Bundle(spark.createDataFrame(points(60, 5, 3), TX), spark.createDataFrame(verts, VERTS), cells), str(tmp_path / "b"))
    cli.main(["coloc", str(tmp_path / "b"), str(tmp_path / "run"), "--groupby", "batch", "--no-prefilter", "--distance", "2", "--pp-alpha", "2", "--cpb-alpha", "2", "--min-genecount", "1"])
    written = {(r.batch, *sorted((r.g1, r.g2))): (r.dominant_region, r.n_proximal_pairs) for r in spark.read.parquet(f"{tmp_path}/run/regions.parquet").collect()}
    assert len({v for v in written.values()}) > 3 and {k[0] for k in written} == {"a", "b"}
    read = results.read_runs(spark, f"{tmp_path}/run")
    got = {(r.batch, *sorted((r.gene_1, r.gene_2))): (r.dominant_region, r.n_proximal_pairs) for r in read.collect()}
    assert got == written and {"n_cells", "dataset", "group"} <= set(read.columns)
    cli.main(["summary", str(tmp_path / "run"), str(tmp_path / "s"), "--context", "batch"])
    tables = {"presence_matrix", "overlaps", "region_distribution", "gene_hubs", "pair_summary", "classes", "overview", "top_pairs"}
    found = {t: spark.read.parquet(f"{tmp_path}/s/{t}.parquet").count() for t in tables}
    assert found["overview"] == 2 and found["top_pairs"] == len(written) and found["presence_matrix"] == 3
    # without regions the same command runs too
    results_of = spark.read.parquet(f"{tmp_path}/run/pairs.parquet")
    results_of.write.parquet(f"{tmp_path}/bare/pairs.parquet")
    cli.main(["summary", str(tmp_path / "bare"), str(tmp_path / "s2"), "--context", "batch"])
    assert {r.dominant_region for r in spark.read.parquet(f"{tmp_path}/s2/top_pairs.parquet").collect()} == {"none"}


def test_regions_of_sampled_cells(spark, tmp_path):
    from loculus.plans import cli
    from loculus.sources.bundle import Bundle, save_bundle

    verts = [v for c in ("c0", "c1") for v in square(c, "cell", -1.0, 13.0) + square(c, "nucleus", 3.0, 8.0)]
    tx = [t for t in points(60, 5, 3) if t[0] in ("c0", "c1")]
    save_bundle(Bundle(spark.createDataFrame(tx, TX), spark.createDataFrame(verts, VERTS), spark.createDataFrame([("c0", "a"), ("c1", "a")], "cell string, batch string")), str(tmp_path / "b"))
    spark.createDataFrame([("g0", "g1")], "gene_1 string, gene_2 string").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "cells.txt").write_text("c1\n\n")
    n = {}
    for name, more in (("all", []), ("one", ["--sampled-cells", str(tmp_path / "cells.txt")])):
        cli.main(["regions", str(tmp_path / "b"), str(tmp_path / "p.parquet"), str(tmp_path / name), "--no-prefilter", "--distance", "2", *more])
        n[name] = sum(r.n_proximal_pairs for r in spark.read.parquet(f"{tmp_path}/{name}.parquet").collect())
    assert n["all"] >= n["one"]
