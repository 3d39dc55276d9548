"""Rules of the engine against plain versions: tails, ordered pairs, groups by themselves, quantiles, points against outlines."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loculus.functions import planar, stats
from loculus.operators import coloc, compartment, geometry


def exact_tail(ps, k):
    pmf = [Fraction(1)]
    for p in map(Fraction, ps):
        pmf = [(pmf[i] if i < len(pmf) else 0) * (1 - p) + (pmf[i - 1] * p if i else 0) for i in range(len(pmf) + 1)]
    return float(sum(pmf[k:]))


@pytest.mark.parametrize(("n", "p", "k"), [(60, 0.02, 20), (60, 0.02, 1), (100, 0.3, 31), (100, 0.3, 90), (40, 0.9, 40), (80, 0.5, 3), (200, 0.01, 25)])
def test_tail_has_one_accuracy(n, p, k):
    rnd = random.Random(n + k)
    ps = [p * rnd.uniform(0.5, 1.1) for _ in range(n)]
    want = exact_tail(ps, k)
    assert stats.poisson_binomial_tail(np.array(ps), k) == pytest.approx(want, rel=1e-9)


def test_chunks_of_cells_give_the_same_p_values(spark):
    """Down to 1e-30, however the cells are cut."""
    rnd = random.Random(3)
    cells = [f"c{i}" for i in range(60)]
    genes = [f"g{i:02d}" for i in range(30)]
    counts = spark.createDataFrame([(c, g, 5) for c in cells for g in genes], "cell string, gene string, n long")
    pairs = [(c, "g00", "g01") for c in cells[:40]] + [(c, *sorted(rnd.sample(genes, 2))) for c in cells for _ in range(6)]
    e = spark.createDataFrame(sorted(set(pairs)), "cell string, g1 string, g2 string")
    one, many = ({(r.g1, r.g2): r.pvalue for r in coloc.conditional_p_values(e, counts, chunk=k).collect()} for k in (20_000, 3))
    assert one.keys() == many.keys() and min(one.values()) < 1e-12
    for k, v in one.items():
        assert v == pytest.approx(many[k], rel=1e-9)


def test_conditional_tail_counts_arrangements():
    """All ways to choose the colocalized cells among ten, three of the type, four with high expression, two of them both."""
    total, m, n1, gamma, n2 = 10, 3, 4, 2, 5
    kind = [1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    high = [1, 1, 0, 1, 1, 0, 0, 0, 0, 0]
    for alpha, lam in itertools.product(range(5), range(4)):
        given = [s for s in itertools.combinations(range(total), n2) if sum(high[i] for i in s) == alpha]
        want = sum(sum(kind[i] for i in s) >= lam for s in given) / len(given)
        assert stats.conditional_tail(gamma, lam, alpha, m, n1, n2, total) == pytest.approx(want)


def test_differential_has_both_orders(spark):
    cells = spark.createDataFrame([(str(i), "a" if i < 4 else "b") for i in range(10)], "cell string, celltype string")
    counts = spark.createDataFrame([(str(i), g, (20 - i) if g == "x" else i + 1) for i in range(10) for g in "xy"], "cell string, gene string, n long")
    e = spark.createDataFrame([(str(i), "x", "y") for i in range(5)], "cell string, g1 string, g2 string")
    got = {(r.g1, r.g2): r for r in coloc.differential(e, counts, cells, "a", gate=1.0).collect()}
    assert set(got) == {("x", "y"), ("y", "x")} and got["x", "y"].uncond == got["y", "x"].uncond
    assert (got["x", "y"].gamma, got["y", "x"].gamma) == (4, 0) and got["x", "y"].cond != got["y", "x"].cond
    every = coloc.differential_all(e, counts, cells).collect()
    assert sorted({r.celltype for r in every}) == ["a", "b"] and len(every) == 4


def test_groups_are_fitted_by_themselves(spark):
    """A second batch leaves every value of the first as it is; a batch that can't be fitted says so."""
    rnd = random.Random(1)
    rows = [("b1", f"c{c}", i, rnd.choice("pqrs"), rnd.uniform(0, 20), rnd.uniform(0, 20)) for c in range(3) for i in range(60)]
    more = [("b2", f"d{c}", i, rnd.choice("pqrt"), rnd.uniform(0, 20), rnd.uniform(0, 20)) for c in range(3) for i in range(40)]
    names = "batch string, cell string, tx_id long, gene string, x double, y double"

    def run(data):
        out = compartment.compartments(spark.createDataFrame(data, names), 1.0, 6.0, "batch", True, 3)
        assert set(out.columns) >= {"batch", "gene", "x", "y", "e1", "subdomain", "status"}
        return {(r.cell, r.tx_id): (round(r.e1, 9), round(r.e2, 9), round(r.e3, 9), r.subdomain) for r in out.where("batch = 'b1'").collect()}

    alone = run(rows)
    assert len(alone) == 180 and alone == run(rows + more)


def test_exact_quantiles(spark):
    rnd = random.Random(2)
    data = {g: [rnd.choice([rnd.gauss(0, 1), 0.25, 1e6]) for _ in range(n)] for g, n in (("a", 997), ("b", 1), ("c", 2))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "g string, v double").repartition(5)
    got = {r.g: r.q for r in compartment.exact_quantiles(df, "v", [0.01, 0.5, 0.99], "g", buckets=16).collect()}
    for g, vs in data.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, [0.01, 0.5, 0.99])))
    assert compartment.exact_quantiles(df.where("v is null"), "v", [0.5]).first().q == [None]
    assert compartment.exact_quantiles(df.where("v is null"), "v", [0.5], "g").count() == 0


def test_points_against_outlines(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    flat = np.array([v for a, b in zip(ring, ring[1:] + ring[:1], strict=True) for v in (*a, *b)])
    x, y = (np.array(v, float) for v in zip((1, 1), (2, 3), (4, 2), (5, 5), (2, 0), (0, 0), (2, 0.5), strict=True))
    first, size = np.zeros(len(x), int), np.full(len(x), 5)
    d, inside, edge = planar.tests(x, y, flat, first, size, most=7)
    assert [bool(i and not e) for i, e in zip(inside, edge, strict=True)] == [True, False, False, False, False, False, True]
    assert edge.tolist() == [False, False, True, False, True, True, False]
    assert d[3] == pytest.approx(math.sqrt(2)) and d[6] == pytest.approx(0.5)
    shapes = geometry.shape_table(geometry.closed_rings(spark.createDataFrame([("c", "cell", i, *p) for i, p in enumerate(ring)] + [("s", "cell", i, 0.2 + a / 9, 0.2 + b / 9) for i, (a, b) in enumerate(ring)], "cell string, kind string, i int, x double, y double")))
    got = sorted((r.cell, r.x, r.y) for r in geometry.raster(shapes).collect())
    assert [g for g in got if g[0] == "c"] == [("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 3.0, 1.0), ("c", 3.0, 2.0)] and len(got) == 5
    sums = {r.cell: r for r in geometry.raster_sums(shapes).collect()}
    assert (sums["c"].r_n, sums["c"].r_x, sums["c"].alone) == (4, 2.0, False) and (sums["s"].r_n, sums["s"].alone) == (1, True)


def test_outlines_may_be_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (None, 1.0, [0.0, 0.0, 1.0, 0.0])], "x double, y double, f array<double>")
    assert [r.t for r in df.select(planar.against(F.col("f"), F.col("x"), F.col("y")).alias("t")).collect()] == [None, None]


def test_null_pairs():
    from loculus.functions import stats

    p = stats.null_pairs(7, 5, 20_000, 2, (1, 2, 3))
    assert p.shape == (20_000, 2, 2) and (p >= 0).all() and (p < 7).all() and (p[..., 0] != p[..., 1]).all()
    # two pairs of a set of five: how often they share points follows from five labels, whatever the seven points
    shared = np.array([len({*x.ravel()}) for x in p])
    rng = np.random.default_rng(5)
    want = []
    for _ in range(20_000):
        some = rng.permutation(7)[:5]
        a, b = rng.choice(some, 2, replace=False), rng.choice(some, 2, replace=False)
        want.append(len({*a, *b}))
    for k in (2, 3, 4):
        assert abs((shared == k).mean() - (np.array(want) == k).mean()) < 0.02
    assert np.bincount(p.ravel(), minlength=7).std() < 400  # no point is preferred
    assert (stats.null_pairs(2, 2, 50, 4, (0,)).sum(axis=2) == 1).all()


def test_permutation_scores_of_large_cells(spark):
    """Cells over the size that one task looks up give the same scores through joins."""
    from loculus.operators import features, geometry

    rng = np.random.default_rng(3)
    tx = [(f"c{c}", f"g{int(g)}", i + 1000 * c, float(x), float(y)) for c, n in enumerate((90, 40, 3)) for i, (g, x, y) in enumerate(zip(rng.integers(0, 6, n) if n > 3 else [0, 1, 1], *rng.uniform(0, 20, (2, n)), strict=True))]
    df = spark.createDataFrame(tx, "cell string, gene string, tx_id long, x double, y double")
    corners = [(f"c{c}", "cell", i, x, y) for c in range(3) for i, (x, y) in enumerate([(0.0, 0.0), (20.0, 0.0), (20.0, 21.0), (0.0, 20.0)])]
    s = geometry.shape_table(geometry.closed_rings(spark.createDataFrame(corners, "cell string, kind string, i int, x double, y double")))
    for score, name in ((features.punctate, "punctate"), (features.radial, "radial")):
        said = lambda d: {(r.cell, r.gene, r.num_gene_spots): (round(r[name], 9), round(r.variance, 9)) for r in d.collect()}  # noqa: E731, B023
        one, joined = said(score(df, s, 40, 3, 7)), said(score(df, s, 40, 3, 7, whole=39))
        assert one == joined and ("c2", "g1", 2) in one and ("c2", "g0", 1) not in one and len({v for v, _ in one.values()}) > 4


@pytest.mark.parametrize("n", [5, 63, 64, 65, 130])
def test_tilted_products_down_to_the_rarest_tails(n):
    rng = np.random.default_rng(n)
    ps = rng.uniform(0, 0.05, n)
    ps[:2] = [0.0, 0.9]
    for k in sorted({0, 1, 2, n // 4, n // 2, n - 2, n - 1, n}):
        want = exact_tail(ps.tolist(), k)
        assert stats.poisson_binomial_tail(ps, k) == pytest.approx(want, rel=1e-9, abs=0), k
    assert exact_tail(ps.tolist(), n // 2) < (1e-30 if n > 60 else 1)


def test_tail_of_a_million_cells():
    ps = np.random.default_rng(1).uniform(0, 0.02, 1_000_000)
    mean, deviation = ps.sum(), math.sqrt((ps * (1 - ps)).sum())
    for z in (-2, 0, 3):
        normal = 0.5 * math.erfc(z / math.sqrt(2))
        assert stats.poisson_binomial_tail(ps, math.ceil(mean + z * deviation)) == pytest.approx(normal, rel=0.05)
    whole = stats.poisson_binomial_tail(ps, math.ceil(mean + 12 * deviation))
    assert 1e-40 < whole < 1e-25
    odds = stats.log_odds(ps)
    k = math.ceil(mean + 12 * deviation)
    tilt = stats.tilt_for(k, *coloc._counted_odds(odds))
    parts, logs = [], 0.0
    for some in np.array_split(ps, 37):  # by chunks, with the tilt of counted log-odds
        q, v = stats.tilted(some, tilt)
        parts.append(stats.trial_sum(q))
        logs += v
    assert stats.tilted_tail(k, *stats.joined_states(parts), tilt, logs) == pytest.approx(whole, rel=1e-9)


def test_tail_of_a_row_rests_on_it_alone():
    """A row that converges late does not make the others go on, which cost time and digits."""
    k, n, p = np.array([3, 2_000_000]), np.array([4_892_515, 4_000_000]), np.array([8.293706485768636e-07, 0.5])
    assert abs(stats.binomial_tail(k, n, p)[0] - stats.binomial_tail(k[:1], n[:1], p[:1])[0]) < 1e-13
