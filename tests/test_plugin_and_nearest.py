"""The registry of features against the fixed operators, its plan, and the nearest points against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import TX, VERTS, points, square

from loculus.operators import features, geometry, joins, plugin

FIXED = [
    "cell_inner_proximity", "nucleus_inner_proximity", "nucleus_outer_proximity", "cell_inner_asymmetry", "nucleus_inner_asymmetry", "nucleus_outer_asymmetry", "point_moment", "point_dispersion_norm",
    "nucleus_dispersion_norm", "nucleus_inner_distance", "nucleus_outer_distance", "nucleus_inner_offset", "nucleus_outer_offset", "nucleus_enrichment", "cell_enrichment", "l_max", "l_half_radius", "l_monotony",
]


@pytest.fixture(scope="module")
def bundle(spark):
    tx = spark.createDataFrame(points(60, 3, 4), TX).cache()
    v = [r for c in range(3) for r in square(f"c{c}", "cell", -1.0, 13.0)] + [r for c in range(2) for r in square(f"c{c}", "nucleus", 3.0, 8.0)]
    return tx, geometry.shape_table(geometry.closed_rings(spark.createDataFrame(v, VERTS)))


def test_features_by_name(bundle):
    tx, s = bundle
    got = {(r.cell, r.gene): r for r in plugin.compute(tx, s, FIXED).collect()}
    p = features.placed(tx, s)
    parts = [features.point_features(p), features.distance_features(p), features.dispersion(tx, s), features.ripley(tx, s)]
    assert len(got) == tx.select("cell", "gene").distinct().count()
    seen = set()
    for df in parts:
        for r in df.collect():
            for name in set(df.columns) & set(FIXED):
                seen.add(name)
                want = r[name]
                have = got[r.cell, r.gene][name]
                assert have == pytest.approx(want, rel=1e-12, nan_ok=True) if want is not None else have is None, (name, r.cell, r.gene)
    assert seen == set(FIXED)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_grouping_and_no_test_that_nobody_needs(spark, bundle, tmp_path):
    tx, s = bundle
    tx.write.parquet(str(tmp_path / "tx"))
    tx = spark.read.parquet(str(tmp_path / "tx"))
    s.write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    on_points = [n for n in FIXED if not n.startswith("l_") and "dispersion" not in n]
    whole = plan_of(plugin.compute(tx, s, on_points))
    assert whole.count("Aggregate [cell") == 1 and whole.count("/tx") + whole.count("tx_id") <= 1 + whole.count("Relation")
    assert whole.count("ArrowEvalPython") + whole.count("against") >= 1
    plain = plan_of(plugin.compute(tx, s, ["point_moment", "cell_enrichment"]))
    assert "ArrowEvalPython" not in plain and "flat" not in plain.split("Relation")[0]
    one = plan_of(plugin.compute(tx, s, ["cell_inner_proximity"]))
    assert "nucleus" not in one


def test_registration(spark, bundle):
    tx, s = bundle
    plugin.declared()
    plugin.register(plugin.Feature("spread_x", lambda: F.col("hi_x") - F.col("lo_x"), {"hi_x": lambda: F.max("x"), "lo_x": lambda: F.min("x")}, ("x",)))
    got = {(r.cell, r.gene): r.spread_x for r in plugin.compute(tx, s, ["spread_x", "point_moment"]).collect()}
    want = {(r.cell, r.gene): r.d for r in tx.groupBy("cell", "gene").agg((F.max("x") - F.min("x")).alias("d")).collect()}
    assert got == want
    with pytest.raises(ValueError, match="another aggregate"):
        plugin.register(plugin.Feature("bad", lambda: F.col("hi_x"), {"hi_x": lambda: F.min("x")}, ("x",)))
    with pytest.raises(ValueError, match="nothing gives"):
        plugin.register(plugin.Feature("bad", lambda: F.lit(1), {}, ("colour",)))
    with pytest.raises(ValueError, match="no table"):
        plugin.register(plugin.Feature("bad", lambda: F.lit(1), tables=("none",)))
    with pytest.raises(ValueError, match="no feature"):
        plugin.compute(tx, s, ["bad"])


@pytest.mark.parametrize("k", [1, 3])
def test_nearest(spark, k):
    rng = np.random.default_rng(k)
    right = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (150, 2)))] + [("a", 500 + i, 7.0, 7.0) for i in range(40)] + [("b", 1, 0.0, 0.0), ("b", 2, 5.0, 5.0), ("e", 3, None, 1.0)]
    right += [("far", i, float(x), 0.0) for i, x in enumerate([*range(60), 1000, 1001])]
    left = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 35, (120, 2)))] + [("a", 900, 7.0, 7.0), ("b", 1, 2.5, 2.5), ("c", 1, 0.0, 0.0), ("e", 1, 0.0, 0.0), ("a", 901, None, 0.0)] + [("far", i, 500.0 + i, 3.0) for i in range(5)]
    schema = "cell string, tx_id long, x double, y double"
    got = {}
    for r in joins.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), k, ["cell"], fill=1).collect():
        got.setdefault((r.cell, r.tx_id), []).append((r.rank, r.neighbour, r.d2))
    want = {}
    for c, i, x, y in left:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for d, j, u, v in right if d == c and u is not None and x is not None)[:k]
        if near:
            want[c, i] = [(n, j, d) for n, (d, j) in enumerate(near, 1)]
    assert got.keys() == want.keys()
    for key, rows in got.items():
        assert [r[:2] for r in sorted(rows)] == [w[:2] for w in want[key]], key
        assert [r[2] for r in sorted(rows)] == pytest.approx([w[2] for w in want[key]])


@pytest.mark.parametrize("least", [1, 3])
def test_neighbour_counts_without_the_dense_table(spark, least):
    from loculus.operators import coloc

    rng = np.random.default_rng(least)
    cells = spark.createDataFrame([(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 40, (60, 2)))] + [("lone", 900.0, 900.0)], "cell string, cx double, cy double")
    edges = [(f"c{i}", a, b) for i in range(60) for a, b in (("p", "q"), ("p", "r"), ("q", "q")) if rng.random() < 0.3] + [("lone", "p", "q"), ("c0", "s", "t")]
    e = spark.createDataFrame(edges, "cell string, g1 string, g2 string")
    dense = coloc.neighbour_frequency(e, cells, 6.0, least).groupBy("g1", "g2", "p_global", "edge", F.round("freq", 12).alias("freq")).agg(F.count("*").alias("c"))
    sparse = coloc.neighbour_counts(e, cells, 6.0, least)
    said = lambda d: sorted((r.g1, r.g2, round(r.p_global, 12), r.edge, r.freq, r.c) for r in d.collect())
    assert said(sparse) == said(dense) and sum(r[5] for r in said(sparse)) == 4 * 61
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    a, b = (sorted(tuple(r) for r in coloc.spatial_modulation(x).collect()) for x in (sparse, coloc.neighbour_frequency(e, cells, 6.0, least)))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2:] for x in a], [x[2:] for x in b])
