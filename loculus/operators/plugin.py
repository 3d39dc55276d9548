"""Features of points as entries of a registry, each with the columns and aggregates that it needs.

``compute`` takes the names of some features and plans them together: only the outlines, measures and tests that one of them
needs are joined to the points, an aggregate that several need is worked out once, and one grouping gives all that depends on
points alone. Tables of the cell (its raster) or of pairs of points are added only if they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar
from . import features, geometry

KEYS = features.KEYS
#: What a test of points against an outline gives, by the outline that it takes.
TESTS = {"dc": "c", "in_cell": "c", "dn": "n", "in_nucleus": "n", "on_nucleus": "n"}
SHAPES = {"c": "cell", "n": "nucleus"}
#: Further tables by name: functions of transcripts and shapes, and the keys that they are joined by.
TABLES: dict[str, tuple[Callable[[DataFrame, DataFrame], DataFrame], list[str]]] = {
    "raster": (lambda tx, shapes: geometry.raster_sums(shapes.where("kind = 'cell'")).select("cell", "r_x", "r_y", "r_2"), ["cell"]),
    "nucleus": (lambda tx, shapes: shapes.where("kind = 'nucleus'").select("cell", F.col("gx").alias("nx"), F.col("gy").alias("ny")), ["cell"]),
    "ripley": (features.ripley, KEYS),
}


@dataclass(frozen=True)
class Feature:
    """value is a column over the aggregates and the further tables; aggregates of one name have to be one expression."""

    name: str
    value: Callable[[], Column]
    aggregates: dict[str, Callable[[], Column]] = field(default_factory=dict)
    #: Columns of points, of shapes (c_ or n_ and a column of the shape table) and tests (see TESTS) that the aggregates read.
    needs: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()


REGISTRY: dict[str, Feature] = {}


def register(f: Feature) -> Feature:
    """Add a feature; an error if its aggregates differ from known ones of the same name, or it names unknown needs."""
    for n in f.needs:
        if n not in TESTS and not n.startswith(("c_", "n_")) and n not in ("x", "y", "z"):
            raise ValueError(f"{f.name}: nothing gives {n}")
    if missing := [t for t in f.tables if t not in TABLES]:
        raise ValueError(f"{f.name}: no table {missing[0]}")
    for other in REGISTRY.values():
        for a, make in f.aggregates.items():
            if other.name != f.name and a in other.aggregates and str(make()) != str(other.aggregates[a]()):
                raise ValueError(f"{f.name}: {other.name} has another aggregate {a}")
    REGISTRY[f.name] = f
    return f


def points_for(tx: DataFrame, shapes: DataFrame, needs: set[str]) -> DataFrame:
    """The points with just these columns; each outline is tested once, and only if a test of it is needed."""
    out = tx.select(*KEYS, *[c for c in ("x", "y", "z") if c in needs or c != "z" and (needs & TESTS.keys())])
    for prefix, kind in SHAPES.items():
        tests = {t for t in needs if TESTS.get(t) == prefix}
        plain = sorted(n[2:] for n in needs if n.startswith(f"{prefix}_"))
        if not tests and not plain:
            continue
        cols = [F.col(c).alias(f"{prefix}_{c}") for c in plain]
        if tests and "flat" not in plain:
            cols.append(F.col("flat").alias(f"{prefix}_flat"))
        out = out.join(shapes.where(F.col("kind") == kind).select("cell", *cols), "cell", "inner" if kind == "cell" else "left")
        if tests:
            out = out.withColumn(f"_{prefix}", planar.against(f"{prefix}_flat", "x", "y"))
            t = F.col(f"_{prefix}")
            known = {"dc": t["dist"], "dn": t["dist"], "in_cell": t["inside"] | t["edge"], "in_nucleus": t["inside"] & ~t["edge"], "on_nucleus": t["inside"] | t["edge"]}
            out = out.withColumns({n: known[n] for n in sorted(tests)}).drop(f"_{prefix}")
            if "flat" not in plain:
                out = out.drop(f"{prefix}_flat")
    return out


def compute(tx: DataFrame, shapes: DataFrame, names: list[str]) -> DataFrame:
    """(cell, gene, <names>) for every (cell, gene) of cells with an outline."""
    declared()
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"no feature {unknown[0]}; there are {', '.join(sorted(REGISTRY))}")
    wanted = [REGISTRY[n] for n in names]
    aggregates: dict[str, Callable[[], Column]] = {"n_spots": lambda: F.count("*")}
    for f in wanted:
        aggregates |= f.aggregates
    needs = {n for f in wanted for n in f.needs}
    out = points_for(tx, shapes, needs).groupBy(*KEYS).agg(*[make().alias(a) for a, make in aggregates.items()])
    if not any(n.startswith("c_") or TESTS.get(n) == "c" for n in needs):
        out = out.join(shapes.where("kind = 'cell'").select("cell"), "cell", "left_semi")
    for t in dict.fromkeys(t for f in wanted for t in f.tables):
        make, keys = TABLES[t]
        out = out.join(make(tx, shapes), keys, "left")
    return out.select(*KEYS, *[f.value().alias(f.name) for f in wanted])


# --- the features that come with it ---------------------------------------------------------------------------------------


def _length(x: str, y: str) -> Column:
    return geometry.length(F.col("x") - F.col(x), F.col("y") - F.col(y))


def _declare() -> None:
    radius = {"radius": lambda: F.max("c_radius")}
    nucleus = {"with_nucleus": lambda: F.max(F.col("dn").isNotNull())}
    inner, outer = F.col("in_nucleus"), ~F.col("in_nucleus")
    sides = {"inner": inner, "outer": outer}
    place = ("x", "y")
    column = F.col
    register(Feature("cell_inner_proximity", lambda: (column("radius") - column("mean_dc")) / column("radius"), radius | {"mean_dc": lambda: F.avg("dc")}, ("c_radius", "dc")))
    register(Feature("cell_inner_asymmetry", lambda: column("mean_off_cell") / column("radius"), radius | {"mean_off_cell": lambda: F.avg(_length("c_gx", "c_gy"))}, (*place, "c_radius", "c_gx", "c_gy")))
    for side, where in sides.items():
        near = {f"mean_dn_{side}": lambda where=where: F.avg(F.when(where, column("dn")))}
        off = {f"mean_off_{side}": lambda where=where: F.avg(F.when(where, _length("n_gx", "n_gy")))}
        close = lambda side=side: F.when(column("with_nucleus"), F.coalesce((column("radius") - column(f"mean_dn_{side}")) / column("radius"), F.lit(0.0)))
        apart = lambda side=side: F.when(column("with_nucleus"), F.coalesce(column(f"mean_off_{side}"), F.lit(0.0))) / column("radius")
        register(Feature(f"nucleus_{side}_proximity", close, radius | nucleus | near, ("c_radius", "dn", "in_nucleus")))
        register(Feature(f"nucleus_{side}_asymmetry", apart, radius | nucleus | off, (*place, "c_radius", "dn", "in_nucleus", "n_gx", "n_gy")))
        register(Feature(f"nucleus_{side}_distance", lambda side=side: column(f"mean_dn_{side}"), near, ("dn", "in_nucleus")))
        register(Feature(f"nucleus_{side}_offset", lambda side=side: column(f"mean_off_{side}"), off, (*place, "in_nucleus", "n_gx", "n_gy")))
    register(Feature("nucleus_enrichment", lambda: column("share_in_nucleus"), {"share_in_nucleus": lambda: F.avg(column("in_nucleus").cast("double"))}, ("in_nucleus",)))
    register(Feature("cell_enrichment", lambda: F.lit(1.0)))
    moments = {"mean_x": lambda: F.avg("x"), "mean_y": lambda: F.avg("y"), "mean_2": lambda: F.avg(column("x") * column("x") + column("y") * column("y"))}

    def about(m2: str, mx: str, my: str, x: str, y: str) -> Column:
        return column(m2) - 2 * (column(x) * column(mx) + column(y) * column(my)) + column(x) * column(x) + column(y) * column(y)

    own = lambda: about("mean_2", "mean_x", "mean_y", "mean_x", "mean_y")
    register(Feature("point_moment", own, moments, place))
    register(Feature("point_dispersion_norm", lambda: own() / about("r_2", "r_x", "r_y", "mean_x", "mean_y"), moments, place, ("raster",)))
    register(Feature("nucleus_dispersion_norm", lambda: about("mean_2", "mean_x", "mean_y", "nx", "ny") / about("r_2", "r_x", "r_y", "nx", "ny"), moments, place, ("raster", "nucleus")))
    for name in ("l_max", "l_max_gradient", "l_min_gradient", "l_monotony", "l_half_radius"):
        register(Feature(name, lambda name=name: column(name), tables=("ripley",)))


_declared = False


def declared() -> dict[str, Feature]:
    """The registry with the features above; they need a session, so they are declared at the first call."""
    global _declared
    if not _declared:
        _declared = True
        _declare()
    return REGISTRY
