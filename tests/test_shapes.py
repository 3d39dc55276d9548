"""Repair, further shape measures, exact p-values of medians, readers of results: closed forms and brute force."""

import itertools
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, rows

from loculus.functions import rings, stats
from loculus.operators import features, geometry, shapes, summary, views
from loculus.plans import pipelines
from loculus.queries import ORACLES, QUERIES
from loculus.sources import bundle, results

VERTS = "cell string, kind string, i int, x double, y double"


def vertices(spark, **outlines):
    return spark.createDataFrame([(c, "cell", i, float(x), float(y)) for c, o in outlines.items() for i, (x, y) in enumerate(o)], VERTS)


def closed(*points):
    return np.array([*points, points[0]], float)


def test_loops_of_crossing_rings():
    square = closed((0, 0), (4, 0), (4, 4), (0, 4))
    assert np.array_equal(rings.largest_loop(square), square)
    bow = closed((0, 0), (4, 4), (4, 0), (0, 4))  # two triangles whose areas cancel
    assert sorted(rings.loop_area(x) for x in rings.simple_loops(bow)) == [4.0, 4.0]
    uneven = closed((0, 0), (6, 0), (6, 6), (5, -1), (0, -1))
    assert len(rings.simple_loops(uneven)) > 1
    spike = closed((0, 0), (4, 0), (4, 2), (9, 2), (4, 2), (4, 4), (0, 4))
    assert rings.loop_area(rings.largest_loop(spike)[:-1]) == 16.0
    assert rings.largest_loop(closed((0, 0), (1, 1), (2, 2))) is None
    assert rings.largest_loop(closed((0, 0), (0, 0), (0, 0))) is None


def test_loops_of_random_rings_are_simple():
    rng = np.random.default_rng(3)
    for _ in range(40):
        ring = closed(*rng.random((7, 2)))
        for loop in rings.simple_loops(ring):
            assert len({tuple(p) for p in loop}) == len(loop)
            again = rings.simple_loops(np.vstack([loop, loop[:1]]))
            assert np.isclose(max(map(rings.loop_area, again)), rings.loop_area(loop))


def test_repair_keeps_outlines_that_cancel(spark):
    v = vertices(spark, bow=[(0, 0), (4, 4), (4, 0), (0, 4)], ok=[(0, 0), (2, 0), (2, 2), (0, 2)], line=[(0, 0), (1, 1), (2, 2)])
    assert {r.cell for r in geometry.closed_rings(v).collect()} == {"ok"}
    got = {r.cell: r.area for r in geometry.shape_table(shapes.closed_simple_rings(v)).collect()}
    assert got == {"bow": 4.0, "ok": 4.0}
    assert shapes.closed_simple_rings(v.limit(0)).count() == 0


def test_aspect_ratio_of_turned_rectangles(spark):
    for angle in (0.0, 0.3, 1.1, 2.9):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        box = np.array([(0, 0), (6, 0), (6, 1.5), (3, 1.0), (0, 1.5)]) @ turn.T  # a dent changes nothing
        assert np.isclose(rings.aspect_ratio(box), 4.0)
    assert rings.aspect_ratio(np.array([(0, 0), (1, 1), (2, 2), (3, 3)], float)) is None
    s = geometry.shape_table(geometry.closed_rings(vertices(spark, a=[(0, 0), (6, 0), (6, 2), (0, 2)])))
    assert [r.aspect_ratio for r in shapes.aspect_ratio(s).collect()] == [3.0]


def test_opening_against_brute_force(spark, monkeypatch):
    key = [(0, 0), (14, 0), (14, 6), (26, 6), (26, 8), (14, 8), (14, 14), (0, 14)]  # a square with a thin arm
    s = geometry.shape_table(geometry.closed_rings(vertices(spark, key=key)))
    inner = {(r.x, r.y) for r in geometry.raster(s).collect()}
    radius, flat = s.select("radius", "flat").first()
    depth = radius * 0.2
    xs, ys = (np.array(v) for v in zip(*sorted(inner), strict=True))
    dist, _, _ = rings.planar.tests(xs, ys, np.array(flat), np.zeros(len(xs), np.int64), np.full(len(xs), len(flat) // 4))
    core = [(x, y) for x, y, d in zip(xs, ys, dist, strict=True) if d >= depth]
    want = {(x, y) for x, y in inner if any((x - a) ** 2 + (y - b) ** 2 <= depth**2 for a, b in core)}
    assert want and want < inner
    for piece in (100_000, 40):  # whole and in pieces of a few columns
        monkeypatch.setattr(geometry, "PIECE", piece)
        got = [(r.x, r.y) for r in shapes.opening(s, 0.2).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_median_p_value_counts_draws():
    for n, m in ((7, 3), (8, 4), (9, 2), (6, 6), (5, 1), (10, 5)):
        medians = [float(np.median(c)) for c in itertools.combinations(range(1, n + 1), m)]
        mid = (n + 1) / 2
        for q in sorted(set(medians)):
            far = sum(abs(x - mid) >= abs(q - mid) - 1e-9 for x in medians) / len(medians)
            if q == mid:
                far = 1.0
            assert np.isclose(stats.median_p_value(m, n, q), far), (n, m, q)
    assert stats.median_p_value(4, 3, 1.0) is None
    total = math.comb(600, 40)
    exact = 2 * sum(math.comb(a - 1, 19) * math.comb(600 - b, 19) for a in range(20, 61) for b in range(a + 1, 122 - a)) / total
    assert np.isclose(stats.median_p_value(40, 600, 60.5), exact, rtol=1e-9)
    odd = 2 * sum(math.comb(r - 1, 19) * math.comb(600 - r, 19) for r in range(20, 71)) / math.comb(600, 39)
    assert np.isclose(stats.median_p_value(39, 600, 70.0), odd, rtol=1e-9)


def test_scores_by_name(spark):
    tx = spark.createDataFrame([("a", 1, "g", 1.0, 1.0), ("a", 2, "g", 2.0, 2.0), ("a", 3, "h", 1.0, 2.0)], "cell string, tx_id long, gene string, x double, y double")
    s = geometry.shape_table(geometry.closed_rings(vertices(spark, a=[(0, 0), (4, 0), (4, 4), (0, 4)])))
    got = {(r.gene, r.num_gene_spots, r.num_spots, r.score, r.variance, r.metric) for r in features.score("baseline", tx, s).collect()}
    assert got == {("g", 2, 3, 0.0, 1.0, "baseline"), ("h", 1, 3, 0.0, 1.0, "baseline")}
    assert "score" in features.score("central", tx, s).columns
    with pytest.raises(ValueError, match="no score"):
        features.score("none", tx, s)


def test_example_cells_fall_back(spark):
    tx = spark.createDataFrame([("a", 1, "g", 0.0, 0.0), ("a", 2, "h", 1.0, 0.0), ("b", 1, "g", 0.0, 0.0), ("b", 2, "h", 50.0, 0.0), ("b", 3, "h", 60.0, 0.0)], "cell string, tx_id long, gene string, x double, y double")
    pp = spark.createDataFrame([("a", "g", "h", 0.01)], "cell string, g1 string, g2 string, pvalue double")
    chosen = lambda p, d: [(r.cell, r.chosen_by, r.place) for r in views.example_cells(p, tx, "h", "g", d).orderBy("place").collect()]
    assert chosen(pp, 4.0) == [("a", "pp", 1)]
    assert chosen(pp.limit(0), 4.0) == [("a", "balance", 1)]
    assert chosen(pp.limit(0), 0.5) == [("b", "expression", 1), ("a", "expression", 2)]


def test_largest_component(spark):
    net = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "g1 string, g2 string")
    assert {tuple(r) for r in views.largest_component(net).select("g1", "g2").collect()} == {("a", "b"), ("b", "c")}


def test_results_are_read_back(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "a", "0.001", "x"), ("c", "d", "none", "x")], "gene_1 string, gene_2 string, cpb_pvalue string, dominant_region string")
    regions = spark.createDataFrame([("a", "b", "7", "nuclear"), ("a", "b", "7", "nuclear")], "g1 string, g2 string, n_proximal_pairs string, dominant_region string")
    for group in ("one", "two"):
        bundle.save_table(pairs, f"{tmp_path}/run/{group}/pairs.csv")
    bundle.save_table(regions, f"{tmp_path}/run/two/regions.csv")
    names = {"pairs": "pairs.csv", "regions": "regions.csv"}
    got = results.read_runs(spark, f"{tmp_path}/run", "d", **names)
    said = {(r.dataset, r.group, r.pair, r.cpb_pvalue, r.dominant_region, r.n_proximal_pairs) for r in got.collect()}
    assert said == {
        ("d", "one", "a--b", 0.001, "x", None), ("d", "one", "c--d", None, "x", None),
        ("d", "two", "a--b", 0.001, "nuclear", 7.0), ("d", "two", "c--d", None, None, None),
    }
    bundle.save_table(spark.createDataFrame([("d1", f"{tmp_path}/run/one", "mouse"), ("d2", f"{tmp_path}/run/two", "rat")], "dataset string, result_dir string, species string"), f"{tmp_path}/meta.csv")
    both = results.read_metadata(spark, f"{tmp_path}/meta.csv", **names)
    assert {(r.dataset, r.group, r.species) for r in both.collect()} == {("d1", "global", "mouse"), ("d2", "global", "rat")}
    assert summary.conserved(both).count() == 2
    with pytest.raises(FileNotFoundError):
        results.read_runs(spark, f"{tmp_path}/none", **names)
    results.save_catalog(spark, {"pairs": f"{tmp_path}/run/one/pairs.csv"}, f"{tmp_path}/catalog.json")
    (entry,) = json.loads((tmp_path / "catalog.json").read_text())
    assert (entry["name"], entry["rows"], entry["columns"][0]) == ("pairs", 2, "gene_1")


def test_names_and_cells(spark, tmp_path):
    df = spark.createDataFrame([("a b/c",), ("..",), (None,), ("é-1_",), ("__x.",)], "v string")
    assert [r[0] for r in df.select(results.safe_name("v")).collect()] == ["a_b_c", "unknown", "unknown", "é-1", "x"]
    (tmp_path / "cells.txt").write_text("c1\n\n c2 \nc1\n")
    assert {r.cell for r in results.read_cells(spark, str(tmp_path / "cells.txt")).collect()} == {"c1", "c2"}
    t = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "cell string, inNucleus int")
    assert [r.cell for r in bundle.in_nucleus(t).collect()] == ["a"]


def test_view_tables(spark):
    p = spark.createDataFrame([("b", "a", 1e-6), ("a", "c", 1e-5), ("x", "y", 1e-4)], "gene_1 string, gene_2 string, cpb_pvalue double")
    t = pipelines.view_tables(p)
    assert {(r.g1, r.g2) for r in t["network"].collect()} == {("a", "b"), ("a", "c")}
    assert {r.gene: r.degree for r in t["degrees"].collect()}["a"] == 2
    assert t["heatmap"].where(F.col("g1") == F.col("g2")).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["shape_aspect_ratio", "shape_density", "shape_moment", "shape_opening", "repaired_shapes", "nuclear_gene_counts", "median_rank_p_values", "baseline_score", "network_largest", "presence_genes", "coerced_pairs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "nation", "part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())
