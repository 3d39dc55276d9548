"""Distance joins as equi-joins on a grid.

A cell of the grid is as wide as the radius, so a pair within the radius lies in one grid cell or in two that touch. Each
point is sent to its own grid cell and to half of those around it, so each unordered pair meets exactly once. A hot key
spreads over its grid cells, which plain equality on the key would not do.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import whole


def _bin(c: str, r: float | str) -> Column:
    return F.floor(F.col(c) / (F.col(r) if isinstance(r, str) else F.lit(float(r))))


def _known(points: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Points with a finite place; no other is near anything."""
    for d in dims:
        points = points.where(F.abs(F.col(d)) < float("inf"))
    return points


def _sum_of_squares(dims: tuple[str, ...], a: str, b: str) -> Column:
    out = None
    for d in dims:
        x = F.col(f"{a}.{d}") - F.col(f"{b}.{d}")
        out = x * x if out is None else out + x * x
    return out


def distance_pairs(points: DataFrame, radius: float | str, keys: list[str], dims: tuple[str, ...] = ("x", "y"), ident: str = "tx_id", carry: list[str] | None = None) -> DataFrame:
    """Unordered pairs of points of equal keys with distance <= radius: keys, a (struct), b (struct), d2.

    The radius is a number or the name of a column that is constant within a key.
    """
    own = isinstance(radius, str)
    cols = list(dict.fromkeys([ident, *dims, *(carry or []), *([radius] if own else [])]))
    p = _known(points, dims).select(*keys, F.struct(*cols).alias("p"), *[_bin(d, radius).alias(f"_b{i}") for i, d in enumerate(dims)])
    bins = [f"_b{i}" for i in range(len(dims))]
    half = [o for o in product((0, 1, -1), repeat=len(dims)) if not any(o) or next(x for x in reversed(o) if x) > 0]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)], F.lit(any(o)).alias("other")) for o in half])
    left = p.select(*keys, F.col("p").alias("a"), *bins, F.explode(moves).alias("m"))
    left = left.select(*keys, "a", F.col("m.other").alias("_other"), *[(F.col(b) + F.col(f"m.o{i}")).alias(b) for i, b in enumerate(bins)])
    out = left.join(p.withColumnRenamed("p", "b"), keys + bins)
    d2 = _sum_of_squares(dims, "a", "b")
    once = F.col("_other") | (F.col(f"a.{ident}") < F.col(f"b.{ident}"))
    reach = F.col(f"a.{radius}") if own else F.lit(float(radius))
    return out.where(once & (d2 <= reach * reach)).select(*keys, "a", "b", d2.alias("d2"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str], dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """All (left, right) of equal keys within the radius; columns as structs a and b. The smaller side should be the left."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return _known(df, dims).select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name), *[_bin(d, radius).alias(f"_b{i}") for i, d in enumerate(dims)])

    bins = [f"_b{i}" for i in range(len(dims))]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in product((-1, 0, 1), repeat=len(dims))])
    a = of(left, "a").select(*keys, "a", *bins, F.explode(moves).alias("m"))
    a = a.select(*keys, "a", *[(F.col(b) + F.col(f"m.o{i}")).alias(b) for i, b in enumerate(bins)])
    d2 = _sum_of_squares(dims, "a", "b")
    return a.join(of(right, "b"), keys + bins).where(d2 <= radius * radius).select(*keys, "a", "b", d2.alias("d2"))


def neighbour_cells(cells: DataFrame, dist: float) -> DataFrame:
    """(cell, neighbour) of cells whose centres (cx, cy) are within dist, both ways, none with itself."""
    one = cells.select(F.lit(0).alias("_k"), F.col("cell").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return radius_join(one, one, dist, ["_k"]).where("a.id <> b.id").select(F.col("a.id").alias("cell"), F.col("b.id").alias("neighbour"))


def nearest(left: DataFrame, right: DataFrame, k: int, keys: list[str], ident: str = "tx_id", other: str = "tx_id", fill: int = 4, limit: int = whole.LIMIT) -> DataFrame:
    """(keys, ident, rank, neighbour, d2): the k nearest points of the right of each point of the left, by (x, y), ties to the
    lesser ``other``; all of them where a key has fewer.

    Keys of at most ``limit`` points are worked on in a task each. In larger ones grid cells hold about ``fill`` * k points of the
    right. A round joins a point with the cells up to a reach around its own; it is done if the k-th distance is less than what lies
    beyond them can have, and else goes on with twice the reach, so only points in thin regions look far. Of points of the right at
    one place only the first k can count, so only they are joined.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    a = left.select(*keys, F.col(ident).alias("_id"), none(right, other).alias("_other"), "x", "y", F.lit(False).alias("_right"))
    b = right.select(*keys, none(left, ident).alias("_id"), F.col(other).alias("_other"), "x", "y", F.lit(True).alias("_right"))
    small, large = whole.parted(a.unionByName(b).where("x IS NOT NULL AND y IS NOT NULL"), keys, limit)
    out = whole.nearest(small, k, keys, "_id").withColumnRenamed("_id", ident)
    if large is None:
        return out
    sides = large.where("NOT _right").withColumnRenamed("_id", ident), large.where("_right").drop("_id").withColumnRenamed("_other", other)
    return out.unionByName(_spread_nearest(*sides, k, keys, ident, other, fill))


def _spread_nearest(left: DataFrame, right: DataFrame, k: int, keys: list[str], ident: str, other: str, fill: int) -> DataFrame:
    place = ["x", "y"]
    w = Window.partitionBy(*keys, *place).orderBy(other)
    r = right.select(*keys, F.col(other).alias("_o"), *place).where("x IS NOT NULL AND y IS NOT NULL").withColumnRenamed("_o", other)
    r = store.stored(r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"))
    box = r.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / (fill * k))))
    box = store.stored(box.select(*keys, "x0", "y0", side.cast("long").alias("g"), F.when(wide > 0, wide / side).otherwise(F.lit(1.0)).alias("w")))
    bin_of = lambda c: F.greatest(F.lit(0), F.least(F.col("g") - 1, F.floor((F.col(c) - F.col(f"{c}0")) / F.col("w")).cast("long")))
    cells = r.join(box, keys).select(*keys, bin_of("x").alias("_i"), bin_of("y").alias("_j"), F.struct(F.col(other).alias("id"), "x", "y").alias("b"))
    todo = left.select(*keys, ident, *place).where("x IS NOT NULL AND y IS NOT NULL").join(box, keys).withColumns({"_ci": bin_of("x"), "_cj": bin_of("y")})
    done, reach = None, 1
    while True:
        span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - reach), F.least(F.col("g") - 1, F.col(c) + reach)))  # noqa: E731, B023
        asked = todo.withColumn("_i", span("_ci")).withColumn("_j", span("_cj"))
        met = asked.join(cells, [*keys, "_i", "_j"])
        dx, dy = F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y")
        met = met.select(*keys, ident, F.col("b.id").alias("neighbour"), (dx * dx + dy * dy).alias("d2"))
        at = Window.partitionBy(*keys, ident).orderBy("d2", "neighbour")
        top = met.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
        # what is not joined lies beyond the block's walls, unless the block ends where the points do
        gap = lambda c: F.least(
            F.when(F.col(f"_c{'i' if c == 'x' else 'j'}") - reach > 0, F.col(c) - (F.col(f"{c}0") + (F.col(f"_c{'i' if c == 'x' else 'j'}") - reach) * F.col("w"))).otherwise(F.lit(float("inf"))),  # noqa: B023
            F.when(F.col(f"_c{'i' if c == 'x' else 'j'}") + reach < F.col("g") - 1, F.col(f"{c}0") + (F.col(f"_c{'i' if c == 'x' else 'j'}") + reach + 1) * F.col("w") - F.col(c)).otherwise(F.lit(float("inf"))),  # noqa: B023
        )
        found = store.stored(top)
        last = found.where(F.col("rank") == k).select(*keys, ident, F.col("d2").alias("_d"))
        judged = todo.join(last, [*keys, ident], "left").withColumn("_sure", (F.least(gap("x"), gap("y")) == float("inf")) | F.coalesce(F.sqrt("_d") < F.least(gap("x"), gap("y")) * (1 - 1e-12), F.lit(False)))
        judged = store.stored(judged)
        part = found.join(judged.where("_sure").select(*keys, ident), [*keys, ident], "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = judged.where("NOT _sure").drop("_d", "_sure")
        if not todo.take(1):
            return done.select(*keys, ident, "rank", "neighbour", "d2")
        reach *= 2
