"""Closed-form fixtures and brute force for the spatial operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loculus.functions import stats
from loculus.operators import classify, coloc, compartment, features, geometry, joins, prefilter, region
from loculus.sources import bundle

SQUARE = [("a", "cell", 0, 0.0, 0.0), ("a", "cell", 1, 1.0, 0.0), ("a", "cell", 2, 1.0, 1.0), ("a", "cell", 3, 0.0, 1.0)]
VERTS = "cell string, kind string, i int, x double, y double"
TX = "cell string, tx_id long, gene string, x double, y double"


def points(n=60, cells=3, genes=4, seed=1, size=12.0):
    rng = np.random.default_rng(seed)
    return [(f"c{c}", i, f"g{rng.integers(genes)}", float(rng.random() * size), float(rng.random() * size)) for c in range(cells) for i in range(n)]


def square(cell, kind, lo, hi):
    return [(cell, kind, 0, lo, lo), (cell, kind, 1, hi, lo), (cell, kind, 2, hi, hi), (cell, kind, 3, lo, hi)]


def test_unit_square(spark):
    v = spark.createDataFrame([*SQUARE, ("flat", "cell", 0, 0.0, 0.0), ("flat", "cell", 1, 1.0, 0.0), ("flat", "cell", 2, 2.0, 0.0), ("nan", "cell", 0, float("nan"), 0.0)], VERTS)
    s = geometry.shape_table(geometry.closed_rings(v))
    r = s.collect()
    assert len(r) == 1
    assert (r[0].area, r[0].perimeter, r[0].gx, r[0].gy, r[0].span) == (1.0, 4.0, 0.5, 0.5, 1)
    assert math.isclose(r[0].radius, math.sqrt(0.5))
    p = spark.createDataFrame([("a", 0.5, 0.5), ("a", 0.0, 0.5), ("a", 1.0, 1.0), ("a", 2.0, 0.5)], "cell string, x double, y double").join(s.select("cell", "segs"), "cell")
    got = p.select("x", geometry.contains(F.col("segs"), F.col("x"), F.col("y")).alias("c"), geometry.covers(F.col("segs"), F.col("x"), F.col("y")).alias("v"), geometry.distance(F.col("segs"), F.col("x"), F.col("y")).alias("d")).collect()
    assert sorted((g.x, g.c, g.v, g.d) for g in got) == [(0.0, False, True, 0.0), (0.5, True, True, 0.5), (1.0, False, True, 0.0), (2.0, False, False, 1.0)]


def test_raster_of_a_small_ring_is_its_centroid(spark):
    v = spark.createDataFrame(square("a", "cell", 0.2, 0.4), VERTS)
    assert [(round(r.x, 6), round(r.y, 6)) for r in geometry.raster(geometry.shape_table(geometry.closed_rings(v))).collect()] == [(0.3, 0.3)]


def test_distance_pairs_equal_brute_force(spark):
    rows = points()
    for dims in (("x", "y"), ("x",)):
        got = {(r.cell, *sorted((r.a.tx_id, r.b.tx_id))) for r in joins.distance_pairs(spark.createDataFrame(rows, TX), 1.5, ["cell"], dims).collect()}
        want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and sum((a[{"x": 3, "y": 4}[d]] - b[{"x": 3, "y": 4}[d]]) ** 2 for d in dims) <= 2.25}
        assert got == want


def test_proximal_pairs(spark):
    rows = points(40, 2, 3)
    got = {(r.cell, r.g1, r.g2): r for r in coloc.proximal_pairs(spark.createDataFrame(rows, TX), 2.0, 20).collect()}
    for c in ("c0", "c1"):
        p = [r for r in rows if r[0] == c]
        close = [(a, b) for i, a in enumerate(p) for b in p[i + 1 :] if math.dist(a[3:], b[3:]) <= 2.0]
        n = {g: sum(r[2] == g for r in p) for g in {r[2] for r in p}}
        p0 = 2 * len(close) / (len(p) * (len(p) - 1))
        for (_, a, b), r in ((k, v) for k, v in got.items() if k[0] == c):
            assert r.obs == sum(sorted((x[2], y[2])) == [a, b] for x, y in close)
            assert r.trials == n[a] * n[b]
            assert math.isclose(r.p0, p0)
            exact = sum(math.comb(r.trials, k) * p0**k * (1 - p0) ** (r.trials - k) for k in range(r.obs, r.trials + 1))
            assert math.isclose(r.pvalue, exact, rel_tol=1e-8, abs_tol=1e-12)
    few = coloc.proximal_pairs(spark.createDataFrame(rows, TX), 2.0, 40)
    assert few.count() == 0


def test_coincident_points_saturate(spark):
    rows = [("c", i, "ab"[i % 2], 1.0, 1.0) for i in range(6)]
    got = coloc.proximal_pairs(spark.createDataFrame(rows, TX), 1.0, 0).collect()
    assert {(r.g1, r.g2, r.obs, r.trials, r.p0, r.pvalue) for r in got} == {("a", "a", 3, 9, 1.0, 1.0), ("a", "b", 9, 9, 1.0, 1.0), ("b", "b", 3, 9, 1.0, 1.0)}


def test_conditional_global_against_dense(spark):
    genes, cells = ["a", "b", "c"], ["1", "2", "3"]
    counts = {("1", "a"): 3, ("1", "b"): 2, ("1", "c"): 1, ("2", "a"): 5, ("2", "b"): 1, ("3", "b"): 2, ("3", "c"): 4}
    edges = [("1", "a", "b"), ("1", "a", "a"), ("2", "a", "b"), ("3", "b", "c")]
    e = spark.createDataFrame(edges, "cell string, g1 string, g2 string")
    c = spark.createDataFrame([(*k, n) for k, n in counts.items()], "cell string, gene string, n long")
    deg = {g: sum((x[1] == g) + (x[2] == g and x[1] != x[2]) for x in edges) for g in genes}
    got = {(r.g1, r.g2): r for r in coloc.conditional_p_values(e, c, observed_only=False).collect()}
    for i, a in enumerate(genes):
        for b in genes[i:]:
            ps = []
            for cell in cells:
                if counts.get((cell, a)) and counts.get((cell, b)):
                    d = sum(deg[g] * deg[h] for k, g in enumerate(genes) for h in genes[k:] if counts.get((cell, g)))
                    ps.append(1 - (1 - deg[a] * deg[b] / d) ** sum(x[0] == cell for x in edges))
            if ps:
                obs = sum(x[1:] == (a, b) for x in edges)
                assert math.isclose(got[a, b].expected, sum(ps), abs_tol=1e-12)
                assert math.isclose(got[a, b].pvalue, stats.poisson_binomial_tail(np.array(ps), obs), abs_tol=1e-12)
    salted = {(r.g1, r.g2): r.pvalue for r in coloc.conditional_p_values(e, c, chunk=1, observed_only=False).collect()}
    assert all(math.isclose(salted[k], r.pvalue, abs_tol=1e-12) for k, r in got.items())


def test_tails():
    for n, p in ((10, 0.3), (400, 0.01), (1849, 0.02)):
        k = np.arange(0, min(n, 40) + 1)
        want = [sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(i, n + 1)) for i in k]
        assert np.allclose(stats.binomial_tail(k, np.full(len(k), n), np.full(len(k), p)), want, rtol=1e-8)
    assert stats.poisson_binomial_tail(np.array([0.5, 0.5]), 1) == pytest.approx(0.75)
    assert stats.hypergeometric_tail(np.array([2]), np.array([10]), np.array([4]), np.array([3]))[0] == pytest.approx((6 * 6 + 4) / 120)
    assert stats.conditional_tail(2, 0, 2, 3, 4, 5, 10) == pytest.approx(1.0)
    assert stats.median_score_variance(1, 5) == pytest.approx(np.mean([((3 - r) / 2) ** 2 for r in range(1, 6)]))
    assert stats.median_score_variance(2, 4) == pytest.approx(np.mean([((2.5 - (a + b) / 2) / 1.5) ** 2 for a in range(1, 5) for b in range(a + 1, 5)]))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = stats.benjamini_hochberg(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "k string, p double"), "p", ["k"]).orderBy("k").collect()
    assert [round(r.p_adjusted, 6) for r in got] == [0.04, 0.053333, 0.053333, 0.5]


def test_rank_scores_and_empty_subsets(spark):
    v = spark.createDataFrame(square("c", "cell", 0.0, 10.0) + square("c", "nucleus", 4.0, 6.0) + square("d", "cell", 0.0, 10.0), VERTS)
    tx = spark.createDataFrame([("c", 1, "g", 1.0, 1.0), ("c", 2, "g", 2.0, 2.0), ("c", 3, "h", 9.5, 5.0), ("d", 1, "g", 5.0, 5.0)], TX)
    s = geometry.shape_table(geometry.closed_rings(v))
    p = features.placed(tx, s)
    f = {(r.cell, r.gene): r for r in features.point_features(p).collect()}
    assert f["c", "g"].nucleus_inner_proximity == 0.0 and f["d", "g"].nucleus_inner_proximity is None
    q = {(r.cell, r.gene): r.peripheral for r in features.peripheral(p).collect()}
    assert q["c", "h"] == 1.0 and q["c", "g"] == -0.5 and q["d", "g"] is None


def test_ripley_of_two_points(spark):
    v = spark.createDataFrame(square("c", "cell", 0.0, 20.0), VERTS)
    s = geometry.shape_table(geometry.closed_rings(v))
    tx = spark.createDataFrame([("c", 1, "g", 1.0, 1.0), ("c", 2, "g", 4.0, 1.0), ("c", 3, "h", 1.0, 1.0)], TX)
    r = {x.gene: x for x in features.ripley(tx, s).collect()}
    assert r["h"].l_max is None
    radii = np.linspace(1, 14, 14)
    h = np.sqrt(2 * 400 * (radii > 3) / 2 / math.pi) - radii
    assert r["g"].l_max == pytest.approx(h.max()) and r["g"].l_half_radius == pytest.approx(math.sqrt(400 / math.pi) - 7)


def test_prefilter_and_sampling(spark):
    tx = spark.createDataFrame(points(50, 4, 3), TX)
    share = lambda sizes, n: {r.stratum: r.share for r in prefilter.allocated(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), n).collect()}
    assert share({"a": 10, "b": 1, "c": 0}, 5) == {"a": 4, "b": 1}
    assert sum(share({"a": 3, "b": 3, "c": 3}, 4).values()) == 4
    assert share({"a": 90, "b": 5, "c": 5}, 10) == {"a": 8, "b": 1, "c": 1} and share({"a": 1, "b": 2}, 9) == {"a": 1, "b": 2}
    assert prefilter.sample_cells(tx, n=2).count() == 2
    with pytest.raises(ValueError):
        prefilter.sample_cells(tx)
    kept = prefilter.min_transcripts(tx, 15)
    assert all(r["n"] >= 15 for r in kept.groupBy("cell", "gene").agg(F.count("*").alias("n")).collect())


def test_nc_ratio_guard(spark):
    v = spark.createDataFrame([r for c in range(9) for r in square(str(c), "cell", 0.0, 10.0) + square(str(c), "nucleus", 0.0, 1.0 + c)], VERTS)
    assert prefilter.nc_ratio_cells(v) is None
    assert prefilter.nc_ratio_cells(v, min_cells=2).count() == 7


def test_permutation_scores_are_repeatable_and_bounded(spark):
    tx = spark.createDataFrame(points(30, 2, 3), TX)
    v = spark.createDataFrame([r for c in range(2) for r in square(f"c{c}", "cell", 0.0, 12.0)], VERTS)
    s = geometry.shape_table(geometry.closed_rings(v))
    for f, name in ((features.punctate, "punctate"), (features.radial, "radial")):
        a = sorted(f(tx, s, 20, 2).collect())
        b = sorted(f(tx.repartition(3), s, 20, 2).collect())
        assert a == b and all(-1 <= r[name] <= 1 for r in a)


def test_shuffled_labels_keep_counts(spark):
    tx = spark.createDataFrame(points(30, 2, 3), TX)
    a = sorted(tx.groupBy("cell", "gene").count().collect())
    assert a == sorted(bundle.shuffled_genes(tx, within="cell").groupBy("cell", "gene").count().collect())
    whole = bundle.shuffled_genes(tx)
    assert sorted(whole.groupBy("gene").count().collect()) == sorted(tx.groupBy("gene").count().collect())
    assert sorted(whole.groupBy("cell").count().collect()) == sorted(tx.groupBy("cell").count().collect())


def test_region_labels_overlap(spark):
    p = spark.createDataFrame([(True, 1.0, 9.0), (True, 3.0, 9.0), (False, 2.0, 1.0), (False, 5.0, 5.0), (False, 5.0, 1.0)], "on_nucleus boolean, dn double, dc double").withColumns({"t1": F.lit(2.5), "t2": F.lit(2.5), "t3": F.lit(4.0)})
    got = [tuple(int(r[k]) for k in region.REGIONS) for r in region.labels(p).collect()]
    assert got == [(0, 1, 0, 0), (1, 0, 0, 0), (0, 1, 0, 1), (0, 0, 1, 0), (0, 0, 0, 1)]


def test_modules(spark):
    e = spark.createDataFrame([(str(c), a, b) for c in range(3) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))] + [("0", "a", "d")], "cell string, g1 string, g2 string")
    assert [(r.genes, r.support) for r in coloc.modules(e, 3, 3).collect()] == [(["a", "b", "c"], 3)]


def test_compartment_pieces(spark):
    assert compartment.elbow({2: 10.0, 3: 4.0, 4: 3.5, 5: 3.0}) == 3
    with pytest.raises(ValueError):
        compartment.elbow({2: 3.0, 3: 2.0, 4: 1.0})
    tx = spark.createDataFrame(points(40, 3, 3), TX).withColumn("batch", F.lit("b"))
    out = compartment.compartments(tx, 0.5, 4.0, "batch", False, 3)
    rows = out.collect()
    assert len(rows) == 120 and {r.subdomain for r in rows} <= {0, 1, 2} and all(0.1 - 1e-9 <= r.e1 <= 0.9 + 1e-9 for r in rows)


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", "g", float(i % 7) / 7, float(i % 5) / 5, "Foci" if i % 7 > 3 else "Other") for i in range(60)], "cell string, gene string, u double, v double, pattern string")
    m = classify.train(rows, ["u", "v"], trees=5, depth=3)
    a = m.predict(rows.drop("pattern"))
    assert {r.pattern for r in a.collect()} == {"Foci", "Other"} and classify.foci_ratio(a) > 0
    m.save(str(tmp_path / "m"))
    assert classify.PatternModel.load(str(tmp_path / "m")).classes == m.classes
    with pytest.raises(RuntimeError):
        classify.PatternModel.load(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        m.predict(rows.drop("u"))


def test_preprocess_and_files(spark, tmp_path):
    raw = spark.createDataFrame([(1, " g ", "1.5", 2.0), (None, "g", "1", 1.0), (2, "h", "nan", 1.0)], "cell int, gene string, x string, y double")
    got = bundle.preprocess(raw).collect()
    assert [(r.cell, r.gene, r.x, r.tx_id) for r in got] == [("1", "g", 1.5, 1)]
    with pytest.raises(ValueError):
        bundle.preprocess(raw.drop("y"))
    path = bundle.save_table(bundle.preprocess(raw), str(tmp_path / "t"))
    assert path.endswith(".parquet") and bundle.read_table(spark, path).count() == 1
    path = bundle.save_table(bundle.preprocess(raw), str(tmp_path / "t.csv"))
    assert bundle.read_table(spark, path).count() == 1
