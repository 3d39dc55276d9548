"""Points against outlines in NumPy, whole Arrow batches at once.

Outlines come flat, four numbers a segment (x1, y1, x2, y2). ``Spread`` lays every point beside each segment of its own outline
and reduces by point, so no loop runs over points or outlines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, DoubleType, StructType

TESTS = StructType().add("dist", DoubleType()).add("inside", BooleanType()).add("edge", BooleanType())


class Spread:
    """Points (x, y), each beside the segments flat[4 * first[i] : 4 * (first[i] + size[i])]."""

    def __init__(self, x: np.ndarray, y: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.start = np.r_[0, np.cumsum(size)[:-1]]
        at = np.repeat(first - self.start, size) + np.arange(size.sum())
        self.x, self.y = np.repeat(x, size), np.repeat(y, size)
        self.x1, self.y1, self.x2, self.y2 = (flat.reshape(-1, 4)[at, k] for k in range(4))
        self.dx, self.dy = self.x2 - self.x1, self.y2 - self.y1

    def distance(self) -> np.ndarray:
        """Distance to the outline."""
        n = self.dx * self.dx + self.dy * self.dy
        t = ((self.x - self.x1) * self.dx + (self.y - self.y1) * self.dy) / np.where(n == 0, 1.0, n)
        t = np.clip(np.where(n == 0, 0.0, t), 0.0, 1.0)
        ex, ey = self.x - (self.x1 + t * self.dx), self.y - (self.y1 + t * self.dy)
        return np.sqrt(np.minimum.reduceat(ex * ex + ey * ey, self.start))

    def inside(self) -> np.ndarray:
        """Odd number of crossings of the ray to the right; says nothing reliable of points on the edge."""
        cross = (self.y1 > self.y) != (self.y2 > self.y)
        left = self.x < self.dx * (self.y - self.y1) / np.where(cross, self.dy, 1.0) + self.x1
        return np.add.reduceat((cross & left).astype(np.int64), self.start) % 2 == 1

    def edge(self) -> np.ndarray:
        on = self.dx * (self.y - self.y1) - self.dy * (self.x - self.x1) == 0
        on &= (self.x >= np.minimum(self.x1, self.x2)) & (self.x <= np.maximum(self.x1, self.x2))
        on &= (self.y >= np.minimum(self.y1, self.y2)) & (self.y <= np.maximum(self.y1, self.y2))
        return np.logical_or.reduceat(on, self.start)


def tests(x: np.ndarray, y: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, inside, edge) of each point, with at most about ``most`` segments laid out at a time."""
    out = (np.empty(len(x)), np.empty(len(x), bool), np.empty(len(x), bool))
    ends = np.cumsum(size)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        s = Spread(x[a:b], y[a:b], flat, first[a:b], size[a:b])
        for o, v in zip(out, (s.distance(), s.inside(), s.edge()), strict=True):
            o[a:b] = v
        a = b
    return out


@arrow_udf(TESTS)
def against(outline: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Distance to the outline, inside and on the edge; null without an outline or a place."""
    lists = outline.combine_chunks() if isinstance(outline, pa.ChunkedArray) else outline
    px, py = (np.asarray(v.to_numpy(zero_copy_only=False), float) for v in (x, y))
    ok = np.asarray(lists.is_valid()) & ~np.isnan(px) & ~np.isnan(py)
    offsets = np.asarray(lists.offsets) // 4
    ok &= np.diff(offsets) > 0
    none = pa.array(~ok)
    cols = [np.zeros(len(ok)), np.zeros(len(ok), bool), np.zeros(len(ok), bool)]
    if ok.any():
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), float)
        for c, v in zip(cols, tests(px[ok], py[ok], flat, offsets[:-1][ok], np.diff(offsets)[ok]), strict=True):
            c[ok] = v
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["dist", "inside", "edge"], mask=none)
