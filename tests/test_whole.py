"""Queries over all points and all gene pairs, against their DuckDB SQL on the smallest tables."""

import glob
import itertools
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, rows

from loculus.operators import coloc
from loculus.queries import ORACLES, QUERIES
from loculus.sources import store
from loculus.sources.fixture import TX, fixture

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "nation", "part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(con.sql(ORACLES[name]).df())
    return got


@pytest.mark.parametrize("name", ["local_composition_all", "composition_flux_all"])
def test_every_point_is_judged(spark, name):
    got = equal_to_sql(spark, name)
    points = fixture(spark, SF).transcripts.select("cell", "tx_id").toPandas()
    assert set(zip(got.cell, got.tx_id, strict=True)) == set(zip(points.cell, points.tx_id, strict=True))


def test_points_go_by_cell_once(spark):
    """From the tables to the result there is one shuffle, nothing is written between, and no price is sent beside its place."""
    before = set(store._STORED)
    plan = QUERIES["local_composition_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(store._STORED) == before and "lineitem.parquet" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "2000" not in plan.split("Exchange hashpartitioning")[1]


def test_points_are_numbered_by_cell(spark):
    """As by supplier, which is the order of the SQL."""
    got = fixture(spark, SF).transcripts
    want = spark.sql(TX).selectExpr("tx_id", "cell", "gene", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "z")
    assert got.schema == want.schema and got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() > 5000


@pytest.mark.parametrize("name", ["region_enrichment_all", "region_fractions_all"])
def test_every_gene_pair_has_regions(spark, name):
    got = equal_to_sql(spark, name)
    genes = sorted(r[0] for r in fixture(spark, SF).transcripts.select("gene").distinct().collect())
    assert set(zip(got.g1, got.g2, strict=True)) == {(a, b) for a in genes for b in genes if a <= b}


def test_regions_of_points_without_a_gene(spark, tmp_path):
    """Such a point counts as its neighbour's gene does, as in the SQL."""
    con = duckdb.connect()
    for t in ("supplier", "nation", "lineitem"):
        con.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS p_brand) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    for t in ("supplier", "nation", "part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = QUERIES["region_fractions_all"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(ORACLES["region_fractions_all"]).df()) and got.g1.isna().any()


def test_a_stored_table_leaves_no_shuffle(spark):
    """Its shuffle's files stayed until the driver collected garbage, so all of a query's shuffles lay on disk at once."""
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    t = store.stored(spark.range(100_000).repartition(7, "id"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and t.count() == 100_000
    assert spark.conf.get(store.CLEANUP) == "false"


def test_edges_are_worked_out_once_for_modules(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda g: seen.add(1) or g, "string").asNondeterministic()
    rows = [(f"c{k}", a, b) for k in range(3) for a, b in ("ab", "ac", "bc", "bd")]
    e = spark.createDataFrame(rows, "cell string, g1 string, g2 string").withColumn("g2", count("g2"))
    assert [(r.genes, r.support) for r in coloc.modules(e, 3, 3).collect()] == [(["a", "b", "c"], 3)]
    assert seen.value == len(rows)


def test_edges_of_modules_are_sent_nowhere_whole(spark):
    """A file of edges is far smaller than its rows: at 60 x sf0.1 5 MB are 860 MB in the driver."""
    edges = [(f"c{k}", *p) for k in range(40) for p in itertools.combinations("abcdef"[: 3 + k % 4], 2)]
    e = spark.createDataFrame([*edges, *edges[:9], (None, "a", "b")], "cell string, g1 string, g2 string")
    for size in (2, 3, 4, 5):
        out = coloc.modules(e, size, 15)
        want = {s: n for s in itertools.combinations("abcdef", size) if (n := sum(set(s) <= set("abcdef"[: 3 + k % 4]) for k in range(40))) >= 15}
        assert {tuple(r.genes): r.support for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [cell" not in plan and ("SortMergeJoin [cell" in plan or size != 3)


def test_pairs_are_fitted_in_many_tasks(spark):
    rows = [(f"g{k}", "h", 0.5, edge, f, 4) for k in range(20) for edge in (0, 1) for f in (0.0, 0.5)]
    freq = spark.createDataFrame(rows, "g1 string, g2 string, p_global double, edge int, freq double, c long")
    got = coloc.spatial_modulation(freq).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.g1 for r in got}) == len(got) == 20 and len({r.task for r in got}) > 1


def test_frequent_subgraphs_equal_sql(spark):
    equal_to_sql(spark, "frequent_subgraphs")
