"""The report of a bundle, reports by batch, and the commands that write them, against pandas and plain counts."""

import json
import os

import pandas as pd
import pytest
from test_engine import TX, VERTS, points, square

from loculus.functions import stats
from loculus.operators import compartment, features, prefilter
from loculus.plans import cli
from loculus.sources.bundle import Bundle, save_bundle

CELLS = ("c0", "c1", "c2", "c3")


def bundle(spark):
    verts = [v for i, c in enumerate(CELLS) for v in square(c, "cell", -1.0, 13.0 + i) + (square(c, "nucleus", 3.0, 8.0) if c != "c3" else [])]
    tx = [t for t in points(60, 5, 3) if t[0] in CELLS]
    cells = spark.createDataFrame([(c, "ab"[i % 2]) for i, c in enumerate(CELLS)], "cell string, batch string")
    return Bundle(spark.createDataFrame(tx, TX), spark.createDataFrame(verts, VERTS), cells)


def test_distributions_like_pandas(spark):
    b = bundle(spark)
    got = prefilter.distributions(b, "raw").toPandas().set_index("measure")
    tx = b.transcripts.toPandas()
    want = {
        "transcripts_per_pair": tx.groupby(["cell", "gene"]).size(), "transcripts_per_cell": tx.groupby("cell").size(), "genes_per_cell": tx.groupby("cell")["gene"].nunique(), "cells_per_gene": tx.groupby("gene")["cell"].nunique(),
        "nc_ratio": pd.Series([25 / (14 + i) ** 2 for i in range(3)]),
    }
    assert set(got.index) == set(want)
    for k, v in want.items():
        row = got.loc[k]
        assert row["n"] == len(v) and row[["mean", "sd", "min", "max"]].tolist() == pytest.approx([v.mean(), v.std(), v.min(), v.max()])
        assert [row[f"q_{q}"] for q in prefilter.QUANTILES] == pytest.approx(v.quantile(list(prefilter.QUANTILES)).tolist())
    none = Bundle(b.transcripts.limit(0), b.vertices.limit(0), None)
    assert prefilter.distributions(none).count() == 0
    assert tuple(prefilter.boundary_counts(none.vertices).first()) == ("", 0, 0, 0)
    assert tuple(prefilter.boundary_counts(b.vertices, "x").first()) == ("x", 4, 3, 3)


def test_filter_of_ratios(spark):
    b = bundle(spark)
    few = prefilter.nc_ratio_report(b.vertices).first()
    assert (few.status, few.n_before, few.n_after, few.n_removed, few.mean_in_target) == ("skipped", 3, 3, 0, False)
    cut = prefilter.nc_ratio_report(b.vertices, 0.1, 0.9, 1, (0.1, 0.2)).first()
    assert (cut.status, cut.n_after, cut.n_removed, cut.mean_in_target) == ("filtered", 1, 2, True)
    assert cut.mean_after == pytest.approx(25 / 15**2) and cut.n_after == prefilter.nc_ratio_cells(b.vertices, 0.1, 0.9, 1).count()
    none = prefilter.nc_ratio_report(b.vertices.limit(0)).first()
    assert (none.status, none.n_before, none.mean_after) == ("skipped", 0, None)


def test_variance_of_a_rank_score(spark):
    """The closed form against sums over all medians."""
    cases = [(m, n) for n in range(1, 14) for m in range(0, n + 2)]
    df = spark.createDataFrame(cases, "num_gene_spots long, num_spots long")
    got = {(r.num_gene_spots, r.num_spots): r.variance for r in features.median_variance(df).collect()}
    for c in cases:
        want = stats.median_score_variance(*c)
        assert got[c] is None if want is None else got[c] == pytest.approx(want, abs=1e-12)


def test_report_by_batch(spark):
    rows = [("a", "c0", 0, "done"), ("a", "c0", 1, "done"), ("a", "c1", 1, "done"), ("b", "c2", None, "failed: too few"), (None, "c4", 0, "done")]
    got = {r.batch: r for r in compartment.group_report(spark.createDataFrame(rows, "batch string, cell string, subdomain int, status string").coalesce(1)).collect()}
    assert got["a"].sizes == {"0": 1, "1": 2} and got["a"].n_subdomains == 2
    assert (got["b"].status, got["b"].sizes, got["b"].n_points, got["b"].n_subdomains) == ("failed: too few", {}, 1, 0)
    assert got[None].n_points == 1 and got[None].sizes == {"0": 1}


def test_commands_write_reports(spark, tmp_path):
    save_bundle(bundle(spark), str(tmp_path / "b"))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    cli.main(["report", str(tmp_path / "b"), str(tmp_path / "r"), "--cellgene-filter-min-transcripts", "1", "--gene-filter-min-cells", "1"])
    assert read("r/funnel").count() == 5 and {r.stage for r in read("r/distributions").collect()} == {"raw", "final"}
    assert {r.stage: r.n_both for r in read("r/boundaries").collect()} == {"raw": 3, "final": 3} and read("r/nc_ratio").count() == 1
    cli.main(["coloc", str(tmp_path / "b"), str(tmp_path / "run"), "--no-prefilter", "--distance", "2", "--pp-alpha", "2", "--cpb-alpha", "2", "--min-genecount", "1", "--use-2d", "--save-matrices"])
    tx = spark.read.parquet(f"{tmp_path}/b/transcripts.parquet")
    assert read("run/gene_counts").agg({"n": "sum"}).first()[0] == tx.count()
    assert {(r.gene_1, r.gene_2) for r in read("run/pairs").collect()} == {(r.g1, r.g2) for r in read("run/all_pairs").collect() if r.g1 < r.g2}
    one = read("run/pairs").orderBy("cpb_pvalue", "gene_1", "gene_2").first()
    for name, more in (("v", []), ("w", ["--pair", one.gene_1, one.gene_2, "--bundle", str(tmp_path / "b"), "--distance", "2"])):
        cli.main(["views", str(tmp_path / "run"), str(tmp_path / name), *more])
        assert {t["name"] for t in json.load(open(f"{tmp_path}/{name}/catalog.json"))} == {"heatmap", "network", "degrees", "components"} | ({"example_cells", "links", "points"} if more else set())
    chosen = {r.cell for r in read("w/example_cells").collect()}
    assert chosen and {r.cell for r in read("w/links").collect()} <= chosen and {r.gene for r in read("w/points").collect()} == {one.gene_1, one.gene_2}
    # without the run's own table by cell the same cells are found
    read("run/pairs").write.parquet(f"{tmp_path}/bare.parquet")
    cli.main(["views", str(tmp_path / "bare.parquet"), str(tmp_path / "u"), "--pair", one.gene_1, one.gene_2, "--bundle", str(tmp_path / "b"), "--distance", "2"])
    assert {r.chosen_by for r in read("u/example_cells").collect()} == {r.chosen_by for r in read("w/example_cells").collect()}
    cli.main(["compartments", str(tmp_path / "b"), str(tmp_path / "p"), "--frac", "1", "--radius", "4", "--n-clusters", "2", "--reports", str(tmp_path / "reports")])
    by = {r.batch: r for r in spark.read.json(f"{tmp_path}/reports/batches").collect()}
    assert set(by) == {"a", "b"} and sum(r.n_points for r in by.values()) == tx.count()
    assert all(os.path.isdir(f"{tmp_path}/reports/batches/batch={x}") for x in "ab") and json.load(open(f"{tmp_path}/reports/catalog.json"))[0]["rows"] == tx.count()
