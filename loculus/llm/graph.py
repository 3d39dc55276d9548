"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

ROWS = 1_000_000  # links that one task of a round is to hold


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. Rows have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
    return moved.select("p.u", "p.v").where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the least id that each linked id reaches, for the ids of edges (u, v).

    Alternating large-star and small-star steps; each is written to the checkpoint folder, so a lost executor costs a step at
    most and no step is computed twice. Minima are combined before the shuffle; the joins are plain equi-joins that AQE may
    split on a hot id. The number of tasks that write follows the number of links.
    Ids without an edge to another id don't appear. Raises if it doesn't settle in max_rounds rounds.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    before = e.agg(mark.alias("m")).first()["m"]
    for _ in range(max_rounds):
        parts = before["n"] // ROWS + 2
        large = written(_large(e).coalesce(parts))
        last, e = e, written(_small(large).coalesce(parts))
        release(large, last)
        now = e.agg(mark.alias("m")).first()["m"]
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
