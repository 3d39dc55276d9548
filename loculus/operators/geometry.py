"""Plane geometry over rings (array of (x, y), closed) and their segments.

Measures of a ring are column expressions. Tests of points against rings run over Arrow batches (``functions.planar``): built-in
higher-order functions would interpret a lambda for every point and segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar

#: Grid points that one piece of a raster holds, and pieces that one task takes.
PIECE, PIECES = 100_000, 8


def closed_outlines(vertices: DataFrame) -> DataFrame:
    """(cell, kind, ring): finite corners in order, closed; those of fewer than three corners are left out.

    A ring is bounded by the outline it describes, so it is the unit that one row holds.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    g = vertices.where(ok("x") & ok("y")).groupBy("cell", "kind").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("v"))
    g = g.select("cell", "kind", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("o")).where(F.size("o") >= 3)
    last = F.element_at("o", -1)
    same = (last["x"] == F.col("o")[0]["x"]) & (last["y"] == F.col("o")[0]["y"])
    return g.select("cell", "kind", F.when(same, F.col("o")).otherwise(F.concat("o", F.slice("o", 1, 1))).alias("ring"))


def closed_rings(vertices: DataFrame) -> DataFrame:
    """(cell, kind, ring, segs) of outlines with an area. Rings are taken as simple; ``shapes.closed_simple_rings`` repairs them."""
    g = closed_outlines(vertices).withColumn("segs", segments(F.col("ring")))
    return g.where(area(F.col("segs")) > 0)


def segments(ring: Column) -> Column:
    ahead = F.slice(ring, 2, F.size(ring) - 1)
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), ahead, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _sum(segs: Column, f) -> Column:
    return F.aggregate(segs, F.lit(0.0), lambda acc, s: acc + f(s))


def cross(s: Column) -> Column:
    return s["x1"] * s["y2"] - s["x2"] * s["y1"]


def area(segs: Column) -> Column:
    return F.abs(_sum(segs, cross)) / 2


def perimeter(segs: Column) -> Column:
    return _sum(segs, lambda s: length(s["x2"] - s["x1"], s["y2"] - s["y1"]))


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def centroid(segs: Column) -> tuple[Column, Column]:
    """Area-weighted."""
    six = 3 * _sum(segs, cross)
    return _sum(segs, lambda s: (s["x1"] + s["x2"]) * cross(s)) / six, _sum(segs, lambda s: (s["y1"] + s["y2"]) * cross(s)) / six


def flat(segs: Column) -> Column:
    """Segments as an array of numbers, four each."""
    return F.flatten(F.transform(segs, lambda s: F.array(s["x1"], s["y1"], s["x2"], s["y2"])))


def contains(segs: Column, x: Column, y: Column) -> Column:
    """Strictly inside: points on the edge are outside."""
    t = planar.against(flat(segs), x, y)
    return t["inside"] & ~t["edge"]


def covers(segs: Column, x: Column, y: Column) -> Column:
    """Inside or on the edge."""
    t = planar.against(flat(segs), x, y)
    return t["inside"] | t["edge"]


def distance(segs: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the ring."""
    return planar.against(flat(segs), x, y)["dist"]


def shape_table(rings: DataFrame) -> DataFrame:
    """Per ring: area, perimeter, bounds, centroid, mean of corners, radius, span, equivalent radius, flat segments."""
    r = rings.withColumns({"area": area(F.col("segs")), "perimeter": perimeter(F.col("segs"))})
    gx, gy = centroid(F.col("segs"))
    r = r.withColumns({"gx": gx, "gy": gy})
    n = F.size("ring")
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, p: acc + f(p))
    far = F.array_max(F.transform("ring", lambda a: F.array_max(F.transform("ring", lambda b: length(a["x"] - b["x"], a["y"] - b["y"])))))
    corners = F.slice("ring", 1, n - 1)
    return r.withColumns({
        "minx": F.array_min(F.transform("ring", lambda p: p["x"])), "miny": F.array_min(F.transform("ring", lambda p: p["y"])),
        "maxx": F.array_max(F.transform("ring", lambda p: p["x"])), "maxy": F.array_max(F.transform("ring", lambda p: p["y"])),
        "radius": total(F.col("ring"), lambda p: length(p["x"] - F.col("gx"), p["y"] - F.col("gy"))) / n,
        "mx": total(corners, lambda p: p["x"]) / (n - 1), "my": total(corners, lambda p: p["y"]) / (n - 1),
        "flat": flat(F.col("segs")), "span": F.floor(far).cast("long"), "eq_radius": F.sqrt(F.col("area") / F.lit(3.141592653589793)),
    })


def raster_pieces(shapes: DataFrame, step: int = 1) -> DataFrame:
    """Rows of shapes with ranges of grid columns (x0, x1) and rows (y0, y1) of at most about PIECE points, dealt over tasks.

    The number of tasks follows the number of grid points. Bounds are cut to integers toward zero.
    """
    b = {c: F.col(f"{m}{a}").cast("long") for a in "xy" for c, m in ((f"{a}0", "min"), (f"{a}1", "max"))}
    s = shapes.withColumns(b)
    columns = F.floor((F.col("x1") - F.col("x0")) / step) + 1
    s = s.withColumns({"_rows": F.floor((F.col("y1") - F.col("y0")) / step) + 1, "_cols": columns})
    s = s.withColumn("_wide", F.greatest(F.lit(1), F.floor(F.lit(PIECE) / F.col("_rows"))).cast("long"))
    points = s.agg(F.coalesce(F.sum(F.col("_rows") * F.col("_cols")), F.lit(0)).alias("n")).first()["n"]
    starts = F.sequence(F.col("x0"), F.col("x1"), F.col("_wide") * step)
    s = s.select("*", F.explode(starts).alias("_at")).withColumns({"x0": F.col("_at"), "x1": F.least(F.col("x1"), F.col("_at") + (F.col("_wide") - 1) * step)})
    tasks = int(points // (PIECE * PIECES)) + 1
    return s.drop("_rows", "_cols", "_wide").repartition(tasks, "cell", "kind", "_at").drop("_at")


def grid_of(x0: int, x1: int, y0: int, y1: int, outline: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of a piece strictly inside an outline."""
    xs, ys = np.arange(x0, x1 + 1, step, dtype=float), np.arange(y0, y1 + 1, step, dtype=float)
    x, y = (v.ravel() for v in np.meshgrid(xs, ys))
    n = len(outline) // 4
    first, size = np.zeros(len(x), np.int64), np.full(len(x), n)
    _, inside, edge = planar.tests(x, y, outline, first, size)
    ok = inside & ~edge
    return x[ok], y[ok]


def raster(shapes: DataFrame, step: int = 1) -> DataFrame:
    """(cell, kind, x, y): integer points inside each ring; the centroid where there is none. Points on the edge are outside."""
    pieces = raster_pieces(shapes, step).select("cell", "kind", "flat", "x0", "x1", "y0", "y1", "gx", "gy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, y = grid_of(r.x0, r.x1, r.y0, r.y1, np.asarray(r.flat, float), step)
                if len(x):
                    yield pd.DataFrame({"cell": r.cell, "kind": r.kind, "x": x, "y": y})

    points = pieces.mapInPandas(run, "cell string, kind string, x double, y double")
    sums = raster_sums(shapes, step)
    none = shapes.join(sums.where("alone").select("cell", "kind"), ["cell", "kind"], "left_semi")
    return points.unionByName(none.select("cell", "kind", F.col("gx").alias("x"), F.col("gy").alias("y")))


def raster_sums(shapes: DataFrame, step: int = 1) -> DataFrame:
    """(cell, kind, r_n, r_x, r_y, r_2, alone): number and means of x, y, x^2 + y^2 of each ring's raster.

    Pieces are summed where they are made, so no raster point leaves its task; ``alone`` says that the centroid stands in.
    """
    pieces = raster_pieces(shapes, step).select("cell", "kind", "flat", "x0", "x1", "y0", "y1", "gx", "gy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, y = grid_of(r.x0, r.x1, r.y0, r.y1, np.asarray(r.flat, float), step)
                out.append((r.cell, r.kind, r.gx, r.gy, len(x), x.sum(), y.sum(), (x * x + y * y).sum()))
            yield pd.DataFrame(out, columns=["cell", "kind", "gx", "gy", "n", "sx", "sy", "s2"])

    s = pieces.mapInPandas(run, "cell string, kind string, gx double, gy double, n long, sx double, sy double, s2 double")
    s = s.groupBy("cell", "kind").agg(F.max("gx").alias("gx"), F.max("gy").alias("gy"), *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "s2")])
    mean = lambda c, alone: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(alone)
    gx, gy = F.col("gx"), F.col("gy")
    return s.select(
        "cell", "kind", F.greatest(F.col("n"), F.lit(1)).alias("r_n"), mean("sx", gx).alias("r_x"), mean("sy", gy).alias("r_y"),
        mean("s2", gx * gx + gy * gy).alias("r_2"), (F.col("n") == 0).alias("alone"),
    )


def second_moment(points: DataFrame, keys: list[str], x0: str, y0: str) -> Column:
    dx, dy = F.col("x") - F.col(x0), F.col("y") - F.col(y0)
    return F.avg(dx * dx + dy * dy)


#: Scalar shape features by name: a column of shape_table, or of its joins.
SHAPE_FEATURES = {"area": "area", "perimeter": "perimeter", "radius": "radius", "span": "span", "bounds": ("minx", "miny", "maxx", "maxy")}


def register_shape_feature(name: str, column) -> None:
    """Add a feature: a column name, a tuple of them, or a function of the shape table's row columns."""
    SHAPE_FEATURES[name] = column


def analyze_shapes(shapes: DataFrame, names: list[str]) -> DataFrame:
    out: list[Column] = []
    for n in names:
        c = SHAPE_FEATURES[n]
        out += [F.col(x) for x in c] if isinstance(c, tuple) else [F.col(c) if isinstance(c, str) else c().alias(n)]
    return shapes.select("cell", "kind", *out)
