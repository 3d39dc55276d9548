"""Transcripts, outlines and cells derived from the relational test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bundle import Bundle

TX = """
SELECT row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tx_id,
       CAST(l_suppkey AS STRING) AS cell, p_brand AS gene, l_quantity AS x, l_extendedprice / 2000.0 AS y, CAST(p_size % 3 AS DOUBLE) AS z
FROM lineitem JOIN part ON l_partkey = p_partkey"""

#: The same rows for Spark, numbered by the cell's name: they lie by cell then, so what goes by cell afterwards needs no other shuffle.
#: Places are worked out after that, so no price is sent twice.
TX_BY_CELL = """
SELECT tx_id, cell, p_brand AS gene, l_quantity AS x, l_extendedprice / 2000.0 AS y, CAST(p_size % 3 AS DOUBLE) AS z
FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tx_id
      FROM (SELECT *, CAST(l_suppkey AS STRING) AS cell FROM lineitem JOIN part ON l_partkey = p_partkey))"""

CELLS = """
SELECT CAST(s_suppkey AS STRING) AS cell, CAST(s_nationkey AS STRING) AS fov, CAST(n_regionkey AS STRING) AS celltype, CAST(s_suppkey % 4 AS STRING) AS batch,
       CAST(s_suppkey % 10 AS DOUBLE) * 10.0 AS cx, CAST(floor(s_suppkey / 10) AS DOUBLE) * 10.0 AS cy
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VERTICES = """
SELECT CAST(s_suppkey AS STRING) AS cell, 'cell' AS kind, i, 25.5 + u * (26 + s_suppkey % 7) AS x, 26.5 + v * (28 + s_suppkey % 5) AS y
FROM supplier CROSS JOIN (SELECT * FROM (VALUES (0, -1.0E0, -1.0E0), (1, 1.0E0, -1.0E0), (2, 1.0E0, 1.0E0), (3, -1.0E0, 1.0E0)) AS r(i, u, v)) AS q
UNION ALL
SELECT CAST(s_suppkey AS STRING), 'nucleus', i, 25.5 + s_suppkey % 5 - 2 + u * (8 + s_suppkey % 11), 26.5 + s_suppkey % 3 - 1 + v * (8 + s_suppkey % 11)
FROM supplier CROSS JOIN (SELECT * FROM (VALUES (0, 1.0E0, 0.0E0), (1, 0.7E0, 0.7E0), (2, 0.0E0, 1.0E0), (3, -0.7E0, 0.7E0), (4, -1.0E0, 0.0E0), (5, -0.7E0, -0.7E0), (6, 0.0E0, -1.0E0), (7, 0.7E0, -0.7E0)) AS r(i, u, v)) AS q"""

TABLES = ("supplier", "nation", "part", "lineitem")

#: Common table expressions for the DuckDB side.
CTES = f"tx AS ({TX}), cells AS ({CELLS}), vert AS ({VERTICES})"


def fixture(spark: SparkSession, sf_dir: str) -> Bundle:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    casts: DataFrame = spark.sql(VERTICES).selectExpr("cell", "kind", "i", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y")
    return Bundle(spark.sql(TX_BY_CELL).selectExpr("tx_id", "cell", "gene", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "z"), casts, spark.sql(CELLS))
