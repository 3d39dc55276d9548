"""Further measures of outlines: repair, aspect ratio, density of points, second moment, opening. One row an outline throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from . import geometry


def repaired(outlines: DataFrame) -> DataFrame:
    """(cell, kind, ring) with each ring that crosses itself replaced by its largest simple loop; rings without one are left out."""
    schema = "cell string, kind string, ring array<struct<x:double,y:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, kind, ring in zip(b["cell"], b["kind"], b["ring"], strict=True):
                loop = rings.largest_loop(np.array([(p["x"], p["y"]) for p in ring], float))
                if loop is not None:
                    out.append((cell, kind, [{"x": float(x), "y": float(y)} for x, y in loop]))
            if out:
                yield pd.DataFrame(out, columns=["cell", "kind", "ring"])

    return outlines.select("cell", "kind", "ring").mapInPandas(run, schema)


def closed_simple_rings(vertices: DataFrame) -> DataFrame:
    """As ``geometry.closed_rings``, after repair: a ring whose loops cancel in its area is kept too."""
    r = repaired(geometry.closed_outlines(vertices))
    return r.withColumn("segs", geometry.segments(F.col("ring")))


def aspect_ratio(shapes: DataFrame) -> DataFrame:
    """(cell, kind, aspect_ratio): long by short side of the least rectangle around each ring, in any direction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [rings.aspect_ratio(np.asarray(f, float).reshape(-1, 4)[:, :2]) for f in b["flat"]]
            yield pd.DataFrame({"cell": b["cell"], "kind": b["kind"], "aspect_ratio": pd.Series(found, dtype=float, index=b.index)})

    return shapes.select("cell", "kind", "flat").mapInPandas(run, "cell string, kind string, aspect_ratio double")


def density(placed: DataFrame, shapes: DataFrame) -> DataFrame:
    """(cell, kind, n_points, density): the cell's points inside each ring or on its edge, over its area; null without points."""
    n = placed.groupBy("cell").agg(F.count_if("in_cell").alias("cell_points"), F.count_if("on_nucleus").alias("nucleus_points"))
    own = F.when(F.col("kind") == "cell", F.col("cell_points")).otherwise(F.col("nucleus_points"))
    out = shapes.select("cell", "kind", "area").join(n, "cell", "left").withColumn("n_points", F.coalesce(own, F.lit(0)))
    return out.select("cell", "kind", "n_points", F.when(F.col("n_points") > 0, F.col("n_points") / F.col("area")).alias("density"))


def moment(shapes: DataFrame, step: int = 1) -> DataFrame:
    """(cell, kind, moment): mean squared distance of a ring's raster to its centroid."""
    s = geometry.raster_sums(shapes, step).join(shapes.select("cell", "kind", "gx", "gy"), ["cell", "kind"])
    gx, gy = F.col("gx"), F.col("gy")
    return s.select("cell", "kind", (F.col("r_2") - 2 * (gx * F.col("r_x") + gy * F.col("r_y")) + gx * gx + gy * gy).alias("moment"))


def opening(shapes: DataFrame, proportion: float, step: int = 1) -> DataFrame:
    """(cell, kind, x, y): grid points of each ring's opening by a disc of ``proportion`` times its radius.

    The outline is shrunk by that much and grown again, on the grid: a point stays if a grid point within the disc's radius of it
    lies at least as deep inside. Pieces of a raster look as far beyond their columns as the disc is wide.
    """
    pieces = geometry.raster_pieces(shapes, step).select("cell", "kind", "flat", "x0", "x1", "y0", "y1", (F.col("radius") * proportion).alias("depth"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, y = rings.opened(r.x0, r.x1, r.y0, r.y1, np.asarray(r.flat, float), r.depth, step)
                if len(x):
                    yield pd.DataFrame({"cell": r.cell, "kind": r.kind, "x": x, "y": y})

    return pieces.mapInPandas(run, "cell string, kind string, x double, y double")


RING = "array<struct<x:double,y:double>>"


def valid_outlines(outlines: DataFrame, rule: str = "evenodd", largest: bool = False) -> DataFrame:
    """(cell, kind, part, ring, holes, area) of what each ring encloses, by descending area from part 0; or the largest part only.

    A ring that crosses itself falls into parts, each with its holes; filled is where the winding number is odd ('evenodd') or
    not 0 ('nonzero'). Rings that enclose nothing have no row.
    """
    said = lambda loop: [{"x": float(x), "y": float(y)} for x, y in loop]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, kind, ring in zip(b["cell"], b["kind"], b["ring"], strict=True):
                parts = rings.valid_parts(np.array([(p["x"], p["y"]) for p in ring], float), rule)
                for i, (shell, holes) in enumerate(parts[:1] if largest else parts):
                    out.append((cell, kind, i, said(shell), [said(h) for h in holes], rings.part_area(shell, holes)))
            yield pd.DataFrame(out, columns=["cell", "kind", "part", "ring", "holes", "area"])

    return outlines.select("cell", "kind", "ring").mapInPandas(run, f"cell string, kind string, part int, ring {RING}, holes array<{RING}>, area double")
