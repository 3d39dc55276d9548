"""Helpers shared by the corpus operators: words, hashes, sorted-group iteration, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that separate words: \x20 and \x09-\x0D. ``bytes.split()`` separates at exactly these.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ASCII_UPPER_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER_CHARS = "abcdefghijklmnopqrstuvwxyz"
#: The same class of word characters as a regular expression for Spark and DuckDB.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty; lone surrogates survive."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive word hashes, order kept."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + m])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64)


def sorted_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of equal key from batches that are sorted by key; holds one group at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and tuple(held[-1][key].iloc[-1]) != tuple(k[0]):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        at = 0
        for c in cuts:
            held.append(b.iloc[at:c])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held, at = [], c
        held.append(b.iloc[at:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def by_group(df: DataFrame, key: list[str], fn: Callable[[pd.DataFrame], dict | None], schema: str, rows: int = 20_000) -> DataFrame:
    """Apply fn to each group of equal key, many small groups in one pass: one shuffle and a sort.

    fn gives a dict of columns, or None for no rows. Groups must be bounded by the caller.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        n = 0
        for g in sorted_groups(batches, key):
            r = fn(g)
            if r is None:
                continue
            out.append(r)
            n += len(next(iter(r.values())))
            if n >= rows:
                yield _stack(out)
                out, n = [], 0
        if out:
            yield _stack(out)
        del out
        trimmed()

    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def _stack(parts: list[dict]) -> pd.DataFrame:
    cols = {}
    for c in parts[0]:
        v = [p[c] for p in parts]
        cols[c] = np.concatenate(v) if isinstance(v[0], np.ndarray) else [x for y in v for x in y]
    return pd.DataFrame(cols)


def ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def trimmed() -> None:
    """Give the memory of a finished task back to the system, for Python workers live on with what they once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of a batch's texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_rows(docs: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Callable], fields: str) -> DataFrame:
    """The key columns, as they are (in Arrow, so nulls and large ids survive), and fields computed from the inputs.

    make() is called once a task; what it gives takes a list for each input and returns a tuple of fields for each row.
    """
    schema = f"{ddl(docs, keys)}, {fields}"
    kinds = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in portions(batches):
            rows = list(fn(*[b.column(c).to_pylist() for c in inputs]))
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *made], names=[*keys, *kinds.names])
        del fn
        trimmed()

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keys, *inputs])]).mapInArrow(run, schema)


def map_column(docs: DataFrame, column: str, make: Callable[[], Callable], to: str | None = None, kind: str = "string") -> DataFrame:
    """All columns, with one computed from ``column`` put in its place, or in that of ``to`` (appended if there is none)."""
    to = to or column
    at = docs.columns.index(to) if to in docs.columns else len(docs.columns)
    field = to_arrow_schema(T.StructType.fromDDL(f"`{to}` {kind}")).field(0)
    names = [*docs.columns[:at], to, *docs.columns[at + 1 :]]
    schema = ", ".join(f"`{c}` {kind if c == to else docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in portions(batches):
            cols = list(b.columns)
            cols[at : at + 1] = [pa.array([fn(x) for x in b.column(column).to_pylist()], field.type)]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        del fn
        trimmed()

    return docs.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """The rows, unchanged, whose value passes the test that make() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in portions(batches):
            yield b.filter(pa.array([bool(fn(x)) for x in b.column(column).to_pylist()], pa.bool_()))
        del fn
        trimmed()

    return docs.mapInArrow(run, docs.schema)


_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, where all share one disk, may do without the setting."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (top or os.path.join(tempfile.gettempdir(), "loculus-checkpoints")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a columnar table in the shared checkpoint folder: less disk than checkpoint(); gone at the driver's end,
    or when ``release`` is called."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has been written itself."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for path, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            _delete(spark, path)


#: A key with more than this share of the rows is hot; there are fewer of them than one over it.
HOT_SHARE = 0.001


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key, ``weight`` the number of big's rows of that key, ``total`` that of all rows.

    Fewer than 1 / HOT_SHARE keys can be hot, so these rows are broadcast, and big's rows of them stay where they are. What is
    shuffled has no key of more than that share. Both parts are always in the plan. ``small`` is to be a written table.
    """
    test = F.col(weight) > HOT_SHARE * total
    hot, cold = small.where(test), small.where(~test)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def text_key(c) -> list:
    """Two longs of a 128-bit digest of a text: rows of equal texts share them, ids don't matter. A null text is empty."""
    h = F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(h, at, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c):
    """A-Z to a-z, all else unchanged."""
    return F.translate(c, ASCII_UPPER_CHARS, ASCII_LOWER_CHARS)
