"""Intermediate tables, written once and read by all their consumers.

They lie in the folder of ``spark.checkpoint.dir``, which driver and executors share, so a lost executor costs no more than the
tasks that it ran. They are removed by ``released`` or when the driver ends. What was shuffled to make a table is removed as soon as
the table is there.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that the files of a query's shuffles go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STORED: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, where all share one disk, may do without the setting."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (top or os.path.join(tempfile.gettempdir(), "loculus-checkpoints")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed at the driver's end."""
    if not _STORED:
        atexit.register(_remove_all)
    path = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    _STORED[path] = spark
    return path


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here leave no shuffle files when they end; else these stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "tables")
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def released(*tables: DataFrame) -> None:
    for t in tables:
        path = getattr(t, "_stored_path", None)
        if path in _STORED:
            _remove(_STORED.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for path, spark in _STORED.items():
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            _remove(spark, path)
