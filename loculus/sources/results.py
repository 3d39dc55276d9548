"""Results of earlier runs read back, lists of cells, names fit for paths, and JSON sinks."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary
from ..operators.region import REGIONS
from .bundle import read_table, require

#: Columns of numbers in tables of pairs and of their regions, by the names that a run writes.
PAIR_NUMBERS = ("cpb_pvalue", "cpb_pvalue_raw", "expected_coloc", "distance_threshold", "pp_alpha", "cpb_alpha", "n_cells_pp_significant", "n_cells")
REGION_NUMBERS = ("n_proximal_pairs", "dominant_enrichment_score", "second_enrichment_score", *[f"{k}_enrichment" for k in REGIONS])
REGION_NAMES = ("dominant_region", "second_region")


def numeric(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns that exist as doubles; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def safe_name(c: str | Column) -> Column:
    """A text fit for a path: runs of other characters than letters, digits, _ and - become one _; 'unknown' if nothing is left."""
    text = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string"), r"(?U)[^\w\-]+", "_")
    text = F.regexp_replace(text, r"^[_.]+|[_.]+$", "")
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell) of a text file with a name a line; blank lines and repeats are left out."""
    return spark.read.text(path).select(F.trim("value").alias("cell")).where("cell <> ''").distinct()


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def run_folders(spark: SparkSession, folder: str, pairs: str = "pairs.parquet") -> list[tuple[str, str]]:
    """(group, folder) of each run: the folder itself as 'global' if it has the table of pairs, else its folders that have one."""
    folder = folder.rstrip("/")
    if exists(spark, f"{folder}/{pairs}"):
        return [("global", folder)]
    p, fs = _file_system(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
    return [(n, f"{folder}/{n}") for n in names if exists(spark, f"{folder}/{n}/{pairs}")]


def read_run(spark: SparkSession, folder: str, dataset: str | None = None, group: str = "global", pairs: str = "pairs.parquet", regions: str = "regions.parquet", **more: str | None) -> DataFrame:
    """The pairs of one run with dataset, group and result_dir, their regions, and further constant columns.

    Regions are joined by the pair and by every key column that both tables have, so a run over groups gets each group's own.
    Numbers are cast, since CSV holds texts. Region columns of the table of pairs give way to those of the table of regions.
    Of several rows of regions for a key the least counts. A column named group of the run's own tables stays as it is.
    """
    p = numeric(require(read_table(spark, f"{folder}/{pairs}"), ("gene_1", "gene_2")), PAIR_NUMBERS)
    p = summary.with_pair(p.withColumns({c: F.col(c).cast("string") for c in ("gene_1", "gene_2")}))
    if exists(spark, f"{folder}/{regions}"):
        r = read_table(spark, f"{folder}/{regions}").withColumnsRenamed({"g1": "gene_1", "g2": "gene_2"})
        r = numeric(summary.with_pair(require(r, ("gene_1", "gene_2"))), REGION_NUMBERS)
        kept = [c for c in (*REGION_NUMBERS, *REGION_NAMES) if c in r.columns]
        p = p.drop(*kept)
        values = {*PAIR_NUMBERS, *REGION_NUMBERS, *REGION_NAMES, "n_cells", "gene_1", "gene_2", "dataset", "result_dir"}
        keys = [c for c in p.columns if c in r.columns and c not in values]
        one = r.groupBy(*keys).agg(F.min(F.struct(*kept)).alias("_r")).select(*[F.col(c).alias(f"_{c}") for c in keys], "_r.*") if kept else None
        if one is not None:  # null keys meet each other
            same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
            p = p.join(one, same, "left").drop(*[f"_{c}" for c in keys])
    if "n_cells" not in p.columns and "n_cells_pp_significant" in p.columns:
        p = p.withColumn("n_cells", F.col("n_cells_pp_significant"))
    names = {"dataset": dataset or folder.rstrip("/").rsplit("/", 1)[-1], "group": group, "result_dir": folder}
    if "group" in p.columns:
        del names["group"]
    extra = {k: v for k, v in more.items() if k not in names}
    return p.drop(*names, *extra).select(*[F.lit(v).alias(k) for k, v in names.items()], "*", *[F.lit(v).alias(k) for k, v in extra.items()])


def read_runs(spark: SparkSession, folder: str, dataset: str | None = None, **kw) -> DataFrame:
    """All runs of a folder, one a group, in one table; an error if there is none."""
    found = run_folders(spark, folder, kw.get("pairs", "pairs.parquet"))
    if not found:
        raise FileNotFoundError(f"{folder} holds no run")
    parts = [read_run(spark, at, dataset, group, **kw) for group, at in found]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_metadata(spark: SparkSession, path: str, **kw) -> DataFrame:
    """All runs that a table names, with its other columns as theirs: a row of (dataset, result_dir, ...) a run.

    The table has one row a data set, so the driver may hold it.
    """
    rows = [r.asDict() for r in require(read_table(spark, path), ("dataset", "result_dir")).collect()]
    parts = [read_runs(spark, r.pop("result_dir"), r.pop("dataset"), **r, **kw) for r in rows]
    if not parts:
        raise ValueError(f"{path} names no run")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def save_json(df: DataFrame, path: str) -> str:
    """One object a line."""
    df.write.mode("overwrite").json(path)
    return path


def save_catalog(spark: SparkSession, tables: dict[str, str], path: str) -> None:
    """A JSON file of name, path, columns and number of rows of written tables."""
    rows = []
    for name, at in tables.items():
        df = read_table(spark, at)
        rows.append({"name": name, "path": at, "columns": df.columns, "rows": df.count()})
    p, fs = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(rows, indent=1).encode()))
    out.close()
