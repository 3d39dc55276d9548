"""Tables behind the usual pictures: heatmap, network, cells worth looking at, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import neglog10
from . import joins


def heatmap(cpb: DataFrame, n: int = 80, top: float = 2.2) -> DataFrame:
    """(g1, g2, value) among the n genes of the greatest -log10 p off the diagonal; clipped; the diagonal is the top."""
    v = cpb.where("g1 < g2").select("g1", "g2", neglog10(F.col("pvalue")).alias("v"))
    best = v.select(F.explode(F.array("g1", "g2")).alias("gene"), "v").groupBy("gene").agg(F.max("v").alias("m")).orderBy(F.desc("m"), "gene").limit(n).select("gene")
    g1, g2 = best.withColumnRenamed("gene", "g1"), best.withColumnRenamed("gene", "g2")
    body = v.join(g1, "g1", "left_semi").join(g2, "g2", "left_semi").select("g1", "g2", F.least(F.lit(top), "v").alias("value"))
    return body.union(best.select("gene", "gene", F.lit(top)))


def network(cpb: DataFrame, k: int = 80) -> DataFrame:
    """The k strongest pairs with strength 1 - rank / (n - 1) and layout weight 0.8 + 3.2 strength."""
    top = cpb.where("g1 < g2").orderBy("pvalue", "g1", "g2").limit(k)
    w = Window.orderBy("pvalue", "g1", "g2")  # at most k rows
    r = top.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    s = F.when(F.col("_n") > 1, 1 - F.col("_r") / (F.col("_n") - 1)).otherwise(1.0)
    return r.select("g1", "g2", "pvalue", s.alias("edge_strength"), (0.8 + 3.2 * s).alias("layout_weight"))


def degrees(net: DataFrame) -> DataFrame:
    return net.select(F.explode(F.array("g1", "g2")).alias("gene")).groupBy("gene").agg(F.count("*").alias("degree"))


def cells_by_pp(pp: DataFrame, g1: str, g2: str, n: int = 6) -> DataFrame:
    a, b = sorted((g1, g2))
    return pp.where((F.col("g1") == a) & (F.col("g2") == b)).orderBy("pvalue", "cell").limit(n)


def cells_by_balance(tx: DataFrame, g1: str, g2: str, radius: float, n: int = 6) -> DataFrame:
    """Cells by the lesser of the two genes' shares of points with a partner, then by links / sqrt(n1 n2)."""
    p = joins.distance_pairs(tx.where(F.col("gene").isin(g1, g2)), radius, ["cell"], carry=["gene"]).where("a.gene <> b.gene")
    one, two = sorted((g1, g2))
    ends = p.select("cell", F.when(F.col("a.gene") == one, F.col("a.tx_id")).otherwise(F.col("b.tx_id")).alias("i"), F.when(F.col("a.gene") == two, F.col("a.tx_id")).otherwise(F.col("b.tx_id")).alias("j"))
    hits = ends.groupBy("cell").agg(F.count("*").alias("links"), F.count_distinct("i").alias("h1"), F.count_distinct("j").alias("h2"))
    c = tx.where(F.col("gene").isin(g1, g2)).groupBy("cell").agg(F.count_if(F.col("gene") == one).alias("n1"), F.count_if(F.col("gene") == two).alias("n2"))
    out = hits.join(c, "cell").select("cell", "links", F.least(F.col("h1") / F.col("n1"), F.col("h2") / F.col("n2")).alias("balance"), (F.col("links") / F.sqrt(F.col("n1") * F.col("n2"))).alias("density"))
    return out.orderBy(F.desc("balance"), F.desc("density"), "cell").limit(n)


def cells_by_expression(tx: DataFrame, g1: str, g2: str, n: int = 6) -> DataFrame:
    return tx.where(F.col("gene").isin(g1, g2)).groupBy("cell").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "cell").limit(n)


def example_cells(pp: DataFrame, tx: DataFrame, g1: str, g2: str, radius: float, n: int = 6) -> DataFrame:
    """(cell, chosen_by, place) of up to n cells to look at: by p-value of the pair if there is any, else by balance, else by expression."""
    ways = [("pp", cells_by_pp(pp, g1, g2, n), "pvalue"), ("balance", cells_by_balance(tx, g1, g2, radius, n), "-balance"), ("expression", cells_by_expression(tx, g1, g2, n), "-total")]
    ranked = None
    for i, (name, cells, by) in enumerate(ways):
        ties = ["-density"] if name == "balance" else []
        order = Window.orderBy(*[F.expr(x) for x in (by, *ties)], "cell")  # at most n rows
        part = cells.select("cell", F.lit(name).alias("chosen_by"), F.row_number().over(order).alias("place"), F.lit(i).alias("_way"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = Window.partitionBy(F.lit(0))  # at most 3 n rows
    return ranked.withColumn("_first", F.min("_way").over(first)).where("_way = _first").drop("_way", "_first")


def links(tx: DataFrame, g1: str, g2: str, radius: float) -> DataFrame:
    """(cell, x1, y1, x2, y2): close pairs of one gene each."""
    p = joins.distance_pairs(tx.where(F.col("gene").isin(g1, g2)), radius, ["cell"], carry=["gene"]).where("a.gene <> b.gene")
    flip = F.col("a.gene") == max(g1, g2)
    pick = lambda c, first: F.when(flip == (not first), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return p.select("cell", pick("x", True).alias("x1"), pick("y", True).alias("y1"), pick("x", False).alias("x2"), pick("y", False).alias("y2"))


def largest_component(net: DataFrame) -> DataFrame:
    """The edges of the component with the most genes; of equal ones that of the least name."""
    member = components(net)
    best = member.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = member.join(best, "component", "left_semi").select(F.col("gene").alias("g1"))
    return net.join(kept, "g1", "left_semi")


def components(net: DataFrame) -> DataFrame:
    """(gene, component) of a network's genes: least gene name reached. The network has at most a few hundred edges."""
    both = net.select(F.col("g1").alias("a"), F.col("g2").alias("b")).union(net.select("g2", "g1"))
    label = both.select(F.col("a").alias("gene")).distinct().withColumn("component", F.col("gene"))
    while True:
        step = both.join(label.withColumnRenamed("gene", "b"), "b").groupBy(F.col("a").alias("gene")).agg(F.min("component").alias("m"))
        new = label.join(step, "gene").select("gene", F.least("component", "m").alias("component"))
        rows = new.join(label.withColumnRenamed("component", "old"), "gene").collect()
        label = net.sparkSession.createDataFrame([(r["gene"], r["component"]) for r in rows], "gene string, component string")
        if all(r["component"] == r["old"] for r in rows):
            return label
