"""Triangulation and interpolation, exact bands, arrangements of crossing outlines, frequent subgraphs: against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from loculus.functions import bands, delaunay, rings
from loculus.operators import coloc, geometry, interpolation, region, shapes
from loculus.sources import store

RNG = np.random.default_rng(7)
CLOUDS = {
    "uniform": RNG.uniform(0, 1, (50, 2)), "on a grid": np.array([[i, j] for i in range(6) for j in range(5)], float), "some of a grid": np.unique(RNG.integers(0, 7, (40, 2)), axis=0).astype(float),
    "circle": np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi, 13)[:-1]] + [[0, 0]]), "far away": RNG.uniform(0, 1e-3, (20, 2)) + 1e6,
}


@pytest.mark.parametrize("name", CLOUDS)
def test_triangulation_has_empty_circles(name):
    p = CLOUDS[name]
    tri, beside = delaunay.Triangulation(p).arrays()
    centre, radius = delaunay.circles(p, tri)
    far = np.sqrt(((p[None] - centre[:, None]) ** 2).sum(2))
    assert (far >= radius[:, None] * (1 - 1e-6)).all()
    a, b, c = (p[tri[:, i]] for i in range(3))
    size = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    assert (size > 0).all() and size.sum() == pytest.approx(rings.loop_area(rings.hull(p) - p[0]), rel=1e-6)
    assert set(tri.ravel()) == set(range(len(p)))
    for t, row in enumerate(beside):
        assert all(o < 0 or t in beside[o] for o in row)
    shuffled = p[RNG.permutation(len(p))]
    again = delaunay.Triangulation(shuffled).arrays()[0]
    said = lambda q, t: {frozenset(map(tuple, q[x].tolist())) for x in t}
    assert said(p, tri) == said(shuffled, again)  # ties don't depend on the order of insertion


def test_no_triangle():
    for p in ([], [[0, 0]], [[0, 0], [1, 1]], [[0, 0], [1, 1], [2, 2]]):
        assert delaunay.Triangulation(np.array(p, float).reshape(-1, 2)).arrays()[0].shape == (0, 3)


def test_rounds_write_places_of_open_points_only(spark, monkeypatch):
    """Points that are done leave their place behind."""
    tables, stored = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    at = np.random.default_rng(8).uniform(0, 10, (900, 2)).tolist()
    s = spark.createDataFrame([("a", x, y, x + 2 * y) for x, y in at[:300]], "g string, x double, y double, v double")
    p = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(at[300:])], "g string, tx_id long, x double, y double")
    inside = [r.v - r.x - 2 * r.y for r in interpolation.linear(s, p, ["v"], ["g"], ["tx_id"], False, 25).join(p, ["g", "tx_id"]).collect()]
    assert len(inside) == 600 and sum(abs(d) < 1e-9 for d in inside) > 500
    rounds = [t for t in tables if "done" in t.columns]
    assert len(rounds) > 1 and sum(t.where("done").count() for t in rounds) == 600
    for t in rounds:
        assert t.where("done AND (x IS NOT NULL OR y IS NOT NULL)").count() == 0 == t.where("NOT done AND x IS NULL").count()


@pytest.mark.parametrize("nearest,tile", [(False, 25), (True, 25), (False, 2000)])
def test_linear_interpolation(spark, nearest, tile):
    place = RNG.uniform(0, 10, (300, 2))
    rows = [("a", float(x), float(y), float(np.sin(x) + y)) for x, y in place] + [("b", 1.0, 1.0, 5.0), ("b", 1.0, 1.0, 7.0), ("c", 0.0, 0.0, 1.0), ("c", 1.0, 0.0, 2.0), ("c", 0.0, 1.0, 4.0), ("c", None, 1.0, 9.0), ("l", 0.0, 0.0, 1.0), ("l", 2.0, 2.0, 2.0)]
    at = RNG.uniform(-1, 11, (500, 2))
    points = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("b", 1, 3.0, 3.0), ("c", 1, 0.25, 0.25), ("c", 2, 5.0, 5.0), ("c", 3, None, 0.0), ("d", 1, 1.0, 1.0), ("l", 1, 0.5, 0.5)]
    s, p = spark.createDataFrame(rows, "g string, x double, y double, v double"), spark.createDataFrame(points, "g string, tx_id long, x double, y double")
    got = {(r.g, r.tx_id): r.v for r in interpolation.linear(s, p, ["v"], ["g"], ["tx_id"], nearest, tile).collect()}
    assert len(got) == len(points)
    values = np.array([r[3] for r in rows[:300]])
    tri = delaunay.Triangulation(place).arrays()[0]
    for i, q in enumerate(at):
        want = values[((place - q) ** 2).sum(1).argmin()] if nearest else values.mean()
        for t in tri:  # every triangle, no walk
            a, b, c = place[t]
            w = np.linalg.solve(np.array([a - c, b - c]).T, q - c)
            w = np.array([*w, 1 - w.sum()])
            if (w >= -1e-12).all():
                want = float(w @ values[t])
                break
        assert got["a", i] == pytest.approx(want)
    assert got["b", 1] == 6 and got["c", 1] == pytest.approx(2.0) and got["c", 2] == pytest.approx(4.0 if nearest else 7 / 3) and got["c", 3] == pytest.approx(7 / 3)
    assert got["l", 1] == pytest.approx(1.0 if nearest else 1.5) and got["d", 1] == pytest.approx((values.sum() + 5 + 7 + 7 + 3) / 307)
    assert interpolation.linear(s.limit(0), p.where("g = 'b'"), ["v"], ["g"], ["tx_id"]).first().v is None


def square(a, b):
    return np.array([[a, a], [b, a], [b, b], [a, b], [a, a]], float)


def test_bands_of_squares_and_circles():
    got = bands.areas(square(0, 20), square(7, 13), 1, 2, 3)
    ring = 6 * 4 * 2 + math.pi * 4
    assert got == pytest.approx((16, 36 - 16 + ring, 400 - 36 - ring - (400 - 196), 400 - 196, 400), abs=1e-9)
    turn = np.linspace(0, 2 * math.pi, 181)
    circle = lambda r: np.stack([r * np.cos(turn), r * np.sin(turn)], 1) * math.sqrt(math.pi / 90 / math.sin(math.pi / 90))  # noqa: E731  of the circle's area
    assert bands.areas(circle(10), circle(5), 1, 1.5, 2) == pytest.approx((math.pi * 16, math.pi * (42.25 - 16), math.pi * (64 - 42.25), math.pi * 36, math.pi * 100), abs=2e-2)
    assert bands.areas(square(0, 4), square(1, 3), 5, 0, 0) == pytest.approx((0, 4, 12, 0, 16), abs=1e-9)  # a band wider than the nucleus, and none
    assert bands.areas(square(0, 4), square(10, 12), 1, 1, 1) == pytest.approx((0, 0, 4, 12, 16), abs=1e-9)  # a nucleus elsewhere


def inside_by_grid(ring, step, low, high):
    c = np.arange(low, high, step) + step / 3
    x, y = (v.ravel() for v in np.meshgrid(c, c))
    ins, far = np.zeros(len(x), bool), np.full(len(x), np.inf)
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        if by != ay:
            ins ^= ((ay <= y) != (by <= y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        u = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (d2 or 1), 0, 1)
        far = np.minimum(far, np.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)))
    return ins, far


@pytest.mark.parametrize("seed", range(3))
def test_bands_against_a_grid(seed):
    rng = np.random.default_rng(seed)

    def star(k, r, x, y):
        t, far = np.sort(rng.uniform(0, 2 * math.pi, k)), r * rng.uniform(0.6, 1, k)
        p = np.stack([x + far * np.cos(t), y + far * np.sin(t)], 1)
        return np.vstack([p, p[:1]])

    cell, nucleus = star(14, 10, 0, 0), star(9, 6, 0.5, 1)
    (ic, dc), (i_n, dn) = (inside_by_grid(q, 0.05, -11, 11) for q in (cell, nucleus))
    count = [ic & i_n & (dn > 0.7), ic & ((i_n & (dn <= 0.7)) | (~i_n & (dn <= 1.1))), ic & ~i_n & (dn > 1.1) & (dc > 1.6), ic & ~i_n & (dc <= 1.6), ic]
    assert bands.areas(cell, nucleus, 0.7, 1.1, 1.6) == pytest.approx([m.sum() * 0.0025 for m in count], rel=5e-3)


def test_exact_background_is_the_limit_of_the_raster(spark):
    corners = [("c", k, i, *p) for k, q in (("cell", square(0, 60)), ("nucleus", square(20, 45))) for i, p in enumerate(q[:-1].tolist())]
    s = geometry.shape_table(geometry.closed_rings(spark.createDataFrame(corners, "cell string, kind string, i int, x double, y double")))
    limits = spark.createDataFrame([("c", 2.5, 2.5, 4.0)], "cell string, t1 double, t2 double, t3 double")
    exact, raster = region.exact_background(s, limits).first(), region.background(s, limits).first()
    for k in region.REGIONS:
        assert exact[f"bg_{k}"] == pytest.approx(raster[f"bg_{k}"], abs=0.05)
    assert exact.bg_nuclear == pytest.approx(400 / 3600)


CASES = {
    "figure eight": ([(0, 0), (4, 4), (4, 0), (0, 4)], [0, 0]), "nested": ([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0), (2, 2), (2, 8), (8, 8), (8, 2), (2, 2)], [1]),
    "touching itself": ([(0, 0), (8, 0), (8, 8), (4, 0), (0, 8)], [0, 0]), "hole at a corner": ([(0, 0), (8, 0), (8, 8), (0, 8), (0, 0), (2, 5), (5, 5), (5, 2)], [1]),
    "walked twice": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)], []), "pentagram": ([(5 + 4 * math.cos(t), 5 + 4 * math.sin(t)) for t in np.arange(5) * 4 * math.pi / 5], [0] * 5),
    "simple": ([(0, 0), (5, 0), (5, 5), (2.5, 2.5), (0, 5)], [0]), "a line": ([(0, 0), (5, 5), (2, 2)], []),
} | {f"random {k}": ([tuple(p) for p in RNG.uniform(0, 9, (6 + k, 2))], None) for k in range(8)} | {f"whole {k}": ([tuple(map(float, p)) for p in RNG.integers(0, 8, (10, 2))], None) for k in range(8)}


@pytest.mark.parametrize("name", CASES)
def test_parts_of_crossing_outlines(name):
    corners, holes = CASES[name]
    ring = np.array([*corners, corners[0]], float)
    parts = rings.valid_parts(ring)
    if holes is not None:
        assert [len(h) for _, h in parts] == holes
    sizes = [rings.part_area(*p) for p in parts]
    assert sizes == sorted(sizes, reverse=True) and all(s > 0 for s in sizes)
    assert sum(sizes) == pytest.approx(inside_by_grid(ring, 0.02, -1, 10)[0].sum() * 0.0004, abs=0.12)
    for shell, inner in parts:
        for loop in (shell, *inner):  # no loop crosses or touches itself
            assert len({tuple(q) for q in loop[:-1]}) == len(loop) - 1
    whole = sum(rings.part_area(*p) for p in rings.valid_parts(ring, "nonzero"))
    assert whole >= sum(sizes) - 1e-9
    if name == "walked twice":
        assert whole == pytest.approx(16)


def test_valid_outlines(spark):
    rows = [("a", "cell", [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 5.0), (0.0, 0.0)]), ("b", "cell", [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "cell string, kind string, ring array<struct<x:double,y:double>>")
    every = shapes.valid_outlines(df).collect()
    assert [(r.cell, r.part) for r in every] == [("a", 0), ("a", 1)] and every[0].area > every[1].area
    assert shapes.valid_outlines(df, largest=True).first().ring == every[0].ring
    assert shapes.valid_outlines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,m", [(2, 1), (3, 2), (3, 3), (4, 3), (4, 4), (5, 4)])
def test_frequent_subgraphs(spark, n, m):
    rng = np.random.default_rng(n * 10 + m)
    cells = {f"c{k}": {e for e in itertools.combinations("abcdef", 2) if rng.random() < 0.5} for k in range(12)}

    def connected(edges):
        seen, more = set(edges[0]), True
        while more:
            more = False
            for e in edges:
                if len(seen & set(e)) == 1:
                    seen |= set(e)
                    more = True
        return seen == {v for e in edges for v in e}

    want = {}
    for edges in itertools.combinations(sorted(itertools.combinations("abcdef", 2)), m):
        s = sum(set(edges) <= have for have in cells.values())
        if s >= 3 and len({v for e in edges for v in e}) == n and connected(edges):
            want[tuple("--".join(e) for e in edges)] = s
    rows = [(c, a, b) for c, have in cells.items() for a, b in have] + [("c0", "a", "a")]
    got = coloc.subgraphs(spark.createDataFrame(rows, "cell string, g1 string, g2 string"), n, m, 3).collect()
    assert {tuple(r.edges): r.support for r in got} == want and len(got) == len(want) and (want or n == 5)
    assert all(len(r.genes) == n for r in got)
    with pytest.raises(ValueError, match="no connected graph"):
        coloc.subgraphs(spark.createDataFrame(rows, "cell string, g1 string, g2 string"), n, n - 2)


LINES = np.array([(float(q), float(y)) for q in range(1, 21) for y in np.random.default_rng(q).uniform(0, 20, 60)])


def test_a_point_meets_few_triangles_when_it_comes_in(monkeypatch):
    calls, test = [], delaunay.in_circle
    monkeypatch.setattr(delaunay, "in_circle", lambda *p: calls.append(1) or test(*p))
    delaunay.Triangulation(LINES)
    assert len(calls) < 20 * len(LINES)


def test_rounds_take_on_few_samples_and_change_no_value(spark):
    n = len(LINES)
    fixed = {"x0": 1.0, "x1": 20.0, "y0": 0.0, "y1": 20.0, "k": 1, "wx": 19.0, "wy": 20.0, "m_v": 0.5}
    rows = [{"g": "a", "ti": 0, "tj": 0, "part": 0, "kind": 0, "id": None, "x": x, "y": y, "v": x * y, "own": True, **fixed} for x, y in LINES.tolist()]
    kinds = pa.schema([("g", pa.string()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("v", pa.float64()), ("done", pa.bool_())])
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64() if c == "id" else pa.infer_type([v])) for c, v in rows[0].items()]))
    left = {(r["x"], r["y"]) for b in interpolation._tiles(["v"], ["g"], ["id"], interpolation.HALO, False, kinds)([batch]) for r in b.to_pylist() if r["done"] is None}
    assert {tuple(p) for p in rings.hull(LINES).tolist()} <= left and len(left) < n / 4
    at = RNG.uniform(0, 21, (400, 2))
    s = spark.createDataFrame([("a", x, y, x * y) for x, y in LINES.tolist()], "g string, x double, y double, v double")
    p = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(at.tolist())], "g string, tx_id long, x double, y double")
    by = lambda nearest, tile: {r.tx_id: r.v for r in interpolation.linear(s, p, ["v"], ["g"], ["tx_id"], nearest, tile).collect()}
    for nearest in (False, True):
        assert by(nearest, 100) == pytest.approx(by(nearest, 10**6))
