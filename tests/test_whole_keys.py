"""Keys that fit a task against the grid joins, and how little is sent on."""

import random

import pytest

from pyspark.sql import functions as F

from loculus.operators import coloc, compartment, features, geometry, interpolation, joins, region

POINTS = "cell string, gene string, tx_id long, x double, y double, z double"


def points(n=90, cells=4, genes=5, seed=7):
    """Points on a lattice, so that distances often equal the radius; some places and genes are null, NaN or infinite."""
    r = random.Random(seed)
    out = [(f"c{i % cells}", f"g{r.randrange(genes)}", i, float(r.randrange(12)), float(r.randrange(12)), float(i % 3)) for i in range(n * cells)]
    odd = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, None)]
    return [*out, *[("c0", "g0", 10_000 + i, x, y, 0.0) for i, (x, y) in enumerate(odd)], ("alone", "g1", 20_000, 1.0, 1.0, 0.0)]


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def exchanges(df):
    """Shuffles of the plan; broadcasts aside."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("every", [True, False])
def test_composition_of_whole_cells(spark, every):
    tx = spark.createDataFrame(points(), POINTS)
    s = tx if every else tx.where("tx_id % 4 = 0")
    assert rows(compartment.local_composition(s, tx, 3.0, ["cell"])) == rows(compartment._spread_composition(s, tx, 3.0, ["cell"]))
    mixed = compartment.local_composition(s, tx, 3.0, ["cell"], limit=92)  # one cell is above the limit
    assert rows(mixed) == rows(compartment._spread_composition(s, tx, 3.0, ["cell"]))
    want = rows(compartment.flux(compartment._spread_composition(s, tx, 3.0, ["cell"]), tx))
    assert rows(compartment.local_flux(s, tx, 3.0, ["cell"])) == want == rows(compartment.local_flux(s, tx, 3.0, ["cell"], limit=92))


def test_flux_is_sent_nowhere(spark):
    """It is not shuffled after it is made."""
    tx = spark.createDataFrame(points(), POINTS)
    above = compartment.local_flux(tx, tx, 3.0, ["cell"])._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "Exchange" not in above


def test_composition_is_sent_on_by_cell_once(spark):
    """One shuffle, of points; none of the rows of the result."""
    tx = spark.createDataFrame(points(), POINTS)
    assert exchanges(compartment.local_composition(tx, tx, 3.0, ["cell"])) == 1


@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
def test_pairs_of_whole_cells(spark, dims):
    tx = spark.createDataFrame(points(), POINTS)
    want = rows(coloc.proximal_pairs(tx, 2.0, 20, None, dims, limit=0))
    assert len(want) > 50 and rows(coloc.proximal_pairs(tx, 2.0, 20, None, dims)) == want == rows(coloc.proximal_pairs(tx, 2.0, 20, None, dims, limit=92))
    assert exchanges(coloc.proximal_pairs(tx, 2.0, 20, None, dims)) == 1  # points by cell; pairs are not sent on


def test_regions_of_whole_cells(spark):
    tx = spark.createDataFrame(points(), POINTS)
    tx = tx.withColumns({k: ((F.col("tx_id") * (i + 3)) % 2).cast("double") for i, k in enumerate(region.REGIONS)})
    wanted = spark.createDataFrame([("g0", "g1"), ("g2", "g2")], "g1 string, g2 string")
    want = rows(region.pair_regions(tx, 2.0, wanted, limit=0))
    assert want and rows(region.pair_regions(tx, 2.0, wanted)) == want


def test_regions_of_all_pairs(spark):
    """Without a list of pairs points are sent once, and a point without a gene counts as in SQL, in large cells too."""
    tx = spark.createDataFrame([*points(), ("c1", None, 30_000, 5.0, 5.0, 0.0)], POINTS)
    tx = tx.withColumns({k: ((F.col("tx_id") * (i + 3)) % 2).cast("double") for i, k in enumerate(region.REGIONS)})
    want = rows(region.pair_regions(tx, 2.0, None, limit=0))
    met = coloc.pair_counts(tx, 2.0, ["cell"], limit=0)
    assert {r[:4] for r in want} == {tuple(r) for r in met.collect()} and len(want) > 50
    assert rows(region.pair_regions(tx, 2.0, None)) == want and exchanges(region.pair_regions(tx, 2.0, None)) == 1


def test_points_are_not_sent_by_gene(spark, monkeypatch):
    """With few genes that would give a few tasks all points."""
    seen = []
    monkeypatch.setattr(region.whole, "parted", lambda p, keys, limit: seen.append(p) or (p, None))
    tx = spark.createDataFrame(points(), POINTS).withColumns({k: F.lit(0.0) for k in region.REGIONS})
    region.pair_regions(tx, 2.0, spark.createDataFrame([("g0", "g1")], "g1 string, g2 string"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_points_are_joined_with_their_cell_once(spark):
    tx = spark.createDataFrame([p for p in points() if p[0] != "alone"], POINTS).withColumn("kind", F.when(F.col("tx_id") % 2 == 0, "even").otherwise("odd"))
    square = [(f"c{i}", k, j, 6.0 + a * w, 6.0 + b * w) for i in range(3) for k, w in (("cell", 7.0 + i), ("nucleus", 2.0)) for j, (a, b) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]) if i or k == "cell"]
    s = geometry.shape_table(geometry.closed_rings(spark.createDataFrame(square, "cell string, kind string, i int, x double, y double")))
    t = spark.createDataFrame([(g, f"c{i}", 1.0 + i, 2.0) for i in range(4) for g in ("even", "odd") if (i, g) != (1, "odd")], "kind string, cell string, t1 double, t2 double")
    got = features.placed(tx, s, t, ["kind", "cell"])
    want = features.placed(tx, s).join(t, ["kind", "cell"])
    assert repr(rows(got.select(sorted(got.columns)))) == repr(rows(want.select(sorted(want.columns)))) and got.count() > 150

def test_slices_of_whole_cells(spark):
    tx = spark.createDataFrame(points(), POINTS)
    of = lambda limit: coloc.proximal_pairs_by_slice(tx, 2.0, 20, limit=limit)
    assert len(rows(of(0))) > 50 and rows(of(1000)) == rows(of(0)) == rows(of(92))
    assert exchanges(of(1000)) == 1


def test_ripley_of_whole_cells(spark):
    tx = spark.createDataFrame(points(), POINTS)
    s = spark.createDataFrame([(f"c{i}", "cell", 100.0 + i, 7 + 3 * i) for i in range(4)], "cell string, kind string, area double, span long")
    of = lambda limit: sorted((r.cell, r.gene, r.n, r.area, r.span, sorted(r.hist.items()), r.quarter) for r in features.ripley_counts(tx, s, limit).collect())
    assert len(of(0)) == 20 and of(1000) == of(0) == of(92)


def test_nearest_of_whole_cells(spark):
    tx = spark.createDataFrame([p for p in points() if p[2] < 10_000 or p[0] == "alone"], POINTS)
    of = lambda limit: joins.nearest(tx, tx.where("gene = 'g1'"), 3, ["cell"], limit=limit)
    assert len(rows(of(0))) > 900 and rows(of(1000)) == rows(of(0))
    assert exchanges(of(1000)) == 1


def test_both_ranks_in_one_pass(spark):
    p = spark.createDataFrame(points()[:300], POINTS).withColumns({"dc": F.col("x") * F.col("y"), "c_mx": F.lit(5.5), "c_my": F.lit(4.0)})
    keys = ["cell", "gene"]
    want = features.peripheral(p).select(*keys, "peripheral").join(features.central(p).select(*keys, "central"), keys)
    assert rows(features.ranks(p)) == rows(want) and exchanges(features.ranks(p)) == 1


def test_groups_of_one_tile_are_sent_once(spark):
    """Groups with few samples need no rounds; the values are those of the rounds, and groups without samples have the mean."""
    tx = spark.createDataFrame([p for p in points() if p[0] != "alone"], POINTS)
    s = tx.where("tx_id % 3 = 0").withColumn("h", F.col("x") * F.col("y"))
    of = lambda tile: interpolation.linear(s, tx, ["h"], ["cell"], ["tx_id"], tile=tile)
    assert rows(of(2000)) == rows(of(5)) and len(rows(of(2000))) == 364
    assert exchanges(of(2000)) == 1
