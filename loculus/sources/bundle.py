"""The four tables of a data set and their checks: transcripts, ring vertices, cells.

transcripts(cell, tx_id, gene, x, y[, z, ...]); tx_id is unique within a cell and breaks ties.
vertices(cell, kind, i, x, y) with kind 'cell' or 'nucleus': the ring's corners in order, open or closed.
cells(cell[, batch, fov, sample_id, celltype, ...]).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("cell", "gene", "x", "y")


@dataclass(frozen=True)
class Bundle:
    transcripts: DataFrame
    vertices: DataFrame
    cells: DataFrame | None = None

    def with_transcripts(self, df: DataFrame) -> Bundle:
        return replace(self, transcripts=df)


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def preprocess(df: DataFrame) -> DataFrame:
    """Names as text, coordinates as doubles; rows without a name or a finite place are left out; tx_id if absent."""
    df = require(df, REQUIRED)
    casts = {c: F.trim(F.col(c).cast("string")) for c in ("cell", "gene")} | {c: F.col(c).cast("double") for c in ("x", "y", "z") if c in df.columns}
    df = df.withColumns(casts)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    df = df.where(F.col("cell").isNotNull() & F.col("gene").isNotNull() & finite("x") & finite("y"))
    if "tx_id" not in df.columns:
        df = df.withColumn("tx_id", F.row_number().over(Window.partitionBy("cell").orderBy("gene", "x", "y")))
    return df


def from_points(df: DataFrame) -> DataFrame:
    """The table under the names of the colocalization input: uID, gene, absX, absY[, absZ]."""
    z = [F.col("z").alias("absZ")] if "z" in df.columns else []
    return df.select(F.col("cell").alias("uID"), "gene", F.col("x").alias("absX"), F.col("y").alias("absY"), *z)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header line where the path ends with .csv."""
    return spark.read.csv(path, header=True, inferSchema=False) if path.endswith(".csv") else spark.read.parquet(path)


def save_table(df: DataFrame, path: str) -> str:
    """Write Parquet or CSV by the path's end; a path with neither gets .parquet. Returns the path written."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
        return path
    path = path if path.endswith(".parquet") else path + ".parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def read_bundle(spark: SparkSession, folder: str) -> Bundle:
    """transcripts.parquet, vertices.parquet and cells.parquet of a folder."""
    return Bundle(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("transcripts", "vertices", "cells")))


def save_bundle(b: Bundle, folder: str) -> None:
    for name, df in (("transcripts", b.transcripts), ("vertices", b.vertices), ("cells", b.cells)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def attach(df: DataFrame, cells: DataFrame | None, column: str, default: str | None = None) -> DataFrame:
    """The column from the table itself, else from cells; missing values become the default. Without a default the column must exist."""
    if column in df.columns:
        out = df
    elif cells is not None and column in cells.columns:
        out = df.join(cells.groupBy("cell").agg(F.min(column).alias(column)), "cell", "left")
    elif default is None:
        raise ValueError(f"no column {column}")
    else:
        return df.withColumn(column, F.lit(default))
    return out if default is None else out.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(default)))


def in_nucleus(df: DataFrame, column: str = "inNucleus") -> DataFrame:
    """Transcripts marked 1 in the column; an error if there is none."""
    return require(df, (column,)).where(F.col(column).cast("int") == 1)


def wkt(rings: DataFrame) -> DataFrame:
    """(cell, kind, wkt) of closed rings."""
    pairs = F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return rings.select("cell", "kind", F.when(F.size("ring") > 0, F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))"))).otherwise("POLYGON EMPTY").alias("wkt"))


def cluster_cells(df: DataFrame, clusters: DataFrame, wanted: list) -> DataFrame:
    """Transcripts of the cells whose Cluster is among the wanted; clusters(Barcode from 1, Cluster)."""
    c = clusters.where(F.col("Cluster").isin(wanted)).select((F.col("Barcode") - 1).cast("string").alias("cell"), F.col("Cluster").alias("cluster"))
    return df.join(c, "cell")


def bright_points(df: DataFrame, min_intensity: float, min_area: float) -> DataFrame:
    return df.where(F.col("cell").isNotNull() & (F.col("brightness") > min_intensity) & (F.col("area") >= min_area))


def decode_barcodes(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """Gene names of barcode numbers; codebook(gene, bits): the number is the value of the reversed bits."""
    book = codebook.select(F.col("gene").alias("gene"), F.conv(F.reverse("bits"), 2, 10).cast("long").alias("barcode"))
    return df.join(book, "barcode")


def shuffled_genes(df: DataFrame, seed: int = 1, within: str | None = None, parts: int = 64) -> DataFrame:
    """A null data set: gene labels are permuted over the whole table, or within each value of a column; places stay.

    The k-th row by hash lends its label to the k-th row by another hash. Hashes are cut into ``parts`` ranges; a row's rank is
    the rows of lower ranges and its rank in its own, so no task sorts the whole table, and the plan is the same at every size.
    """
    key = [within] if within else []
    ident = [c for c in ("cell", "tx_id") if c in df.columns]

    def ranked(rows: DataFrame, salt: int) -> DataFrame:
        r = rows.withColumn("_h", F.xxhash64(F.lit(salt), *ident))
        r = r.withColumn("_part", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(parts)))
        n = r.groupBy(*key, "_part").agg(F.count("*").alias("_c"))
        skip = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumn("_skip", F.coalesce(F.sum("_c").over(skip), F.lit(0))).drop("_c")  # one row a range
        place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_h", *ident))
        # over the whole table there are as many rows as ranges, within a column as many for each of its values
        return r.join(n if key else F.broadcast(n), [*key, "_part"]).withColumn("_k", F.col("_skip") + place).drop("_h", "_part", "_skip")

    places = ranked(df.drop("gene"), 2 * seed)
    lent = ranked(df.select(*dict.fromkeys([*key, *ident, "gene"])), 2 * seed + 1).select(*key, "_k", "gene")
    return places.join(lent, [*key, "_k"]).drop("_k")
