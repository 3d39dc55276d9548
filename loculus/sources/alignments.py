"""A data source for alignments in the block-compressed binary format, ``spark.read.format("alignments").load(path)``.

A file is cut at fixed places of its compressed bytes, so nothing is read to plan it. A task looks for the first block that begins
in its part, and in it for the first record: the first place from which a chain of records has plausible lengths, names and
references. It reads the records that begin in its blocks; the last one may end in a block of the next part. Files are opened
through pyarrow's file systems and seeked in, from whatever store their URI names.

Comparisons of ref, pos, strand, flag and mapq with constants are pushed down and checked before cigars and tags are decoded.
Where the header says that records are sorted by coordinate, a part that lies before the wanted range is left after one record of
the next part, and one that lies behind it after its first.

Options: ``partBytes`` (64 MiB) or ``parts`` (of each file). A path may be a file, a folder (its files that end with .bam) or
several, comma-separated. A file that is no such file is an error; one without records has no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

SCHEMA = "name string, flag int, ref string, pos long, mapq int, cigar string, n_cigar int, strand string, length int, next_ref string, next_pos long, span long, tags map<string,string>"
ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}.get(k, pa.map_(pa.string(), pa.string()))) for n, k in (f.split(" ") for f in SCHEMA.split(", "))])
FIXED = struct.Struct("<iiiBBHHHiiii")
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
OPERATIONS = "MIDNSHP=X"
#: Bytes in which a block's head is looked for, records that have to follow one another to be believed, rows of a batch.
HEAD_SEARCH, CHAIN, ROWS = 1 << 17, 8, 5000
PUSHED = ("ref", "pos", "strand", "flag", "mapq")


def opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def files_of(path: str) -> list[str]:
    out = []
    for p in path.split(","):
        fs, at = pafs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (pafs.LocalFileSystem(), p)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            head = p[: len(p) - len(at)] if p.endswith(at) else ""
            out += sorted(head + f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".bam"))
        else:
            out.append(p)
    return out


def block_size(head: bytes) -> int | None:
    """Size of the block that begins with these bytes, None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class Blocks:
    """Blocks from a place of the compressed file on, unpacked one at a time."""

    def __init__(self, file, at: int):
        self.file, self.at, self.size = file, at, file.size()

    def next(self) -> tuple[int, bytes] | None:
        """(place, unpacked bytes) of the next block; None at the end."""
        if self.at >= self.size:
            return None
        self.file.seek(self.at)
        head = self.file.read(64)
        n = block_size(head)
        if n is None:
            raise ValueError(f"no block at byte {self.at}")
        data = head + self.file.read(n - len(head)) if n > len(head) else head[:n]
        if len(data) < n:
            raise ValueError(f"the file ends within the block at byte {self.at}")
        at, self.at = self.at, self.at + n
        skip = 12 + struct.unpack_from("<H", data, 10)[0]
        return at, zlib.decompress(data[skip:-8], -15)


def first_block(file, at: int) -> int | None:
    """Where the first block at or behind a place begins; its size has to lead to another block or to the end."""
    size = file.size()
    if not at:
        return 0
    file.seek(at)
    data, i = file.read(HEAD_SEARCH), -1
    while (i := data.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0:
        file.seek(at + i)
        n = block_size(file.read(64))
        if n is None:
            continue
        if at + i + n == size:
            return at + i
        file.seek(at + i + n)
        if block_size(file.read(64)) is not None:
            return at + i
    return None


@dataclass
class Header:
    refs: list[str]
    text: str
    #: Block and place in it where the records begin.
    block: int
    offset: int

    @property
    def is_sorted(self) -> bool:
        return any(line.startswith("@HD") and "SO:coordinate" in line for line in self.text.split("\n")[:1])


def header_of(file) -> Header:
    blocks, data, places = Blocks(file, 0), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            got = blocks.next()
            if got is None:
                raise ValueError("the file ends within its header")
            places.append((got[0], len(data)))
            data += got[1]

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError("not a file of alignments")
    n_text = struct.unpack_from("<i", data, 4)[0]
    need(12 + n_text)
    text = data[8 : 8 + n_text].decode("utf-8", "replace").rstrip("\0")
    n, at, refs = struct.unpack_from("<i", data, 8 + n_text)[0], 12 + n_text, []
    for _ in range(n):
        need(at + 4)
        k = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + k)
        refs.append(data[at + 4 : at + 3 + k].decode("utf-8", "replace"))
        at += 8 + k
    block, start = next((b, s) for b, s in reversed(places) if s <= at)
    return Header(refs, text, block, at - start)


def plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """Where the record at a place ends if it can be one."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, ref2, pos2, _ = FIXED.unpack_from(data, at)
    if not (-1 <= ref < n_refs and -1 <= ref2 < n_refs and pos >= -1 and pos2 >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, n_refs: int, whole: bool) -> int | None:
    """The first place from which a chain of records goes on, to the end of the data if it is ``whole``."""
    for start in range(max(0, len(data) - 36)):
        at, n = start, 0
        while n < CHAIN and at is not None and at + 36 <= len(data):
            at = plausible(data, at, n_refs)
            n += 1
        if at is not None and n and (n == CHAIN or (at == len(data) if whole else at >= len(data) - 36)):
            return start
    return None


def tags_of(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            f = struct.Struct(f"<{n}{NUMBERS[sub]}")
            value, at = ",".join([sub, *map(str, f.unpack_from(data, at + 5))]), at + 5 + f.size
        else:
            f = struct.Struct("<" + NUMBERS[kind])
            value, at = str(f.unpack_from(data, at)[0]), at + f.size
        out[tag] = value
    return out


def cigar_of(codes: tuple[int, ...]) -> str | None:
    return "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in codes) or None


@dataclass
class Part(InputPartition):
    path: str
    low: int
    high: int


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = dict(options), []

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons that are checked on the raw record; all are given back too, for Spark checks them at no great cost."""
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in files_of(self.options["path"]):
            with opened(path) as f:
                size = f.size()
            n = int(self.options.get("parts") or -(-size // int(self.options.get("partBytes", 64 << 20))) or 1)
            cuts = [size * i // n for i in range(n + 1)]
            out += [Part(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _wanted(self, refs: list[str]):
        """A test of (ref number, pos, flag, mapq), and the wanted range (ref number, least, greatest pos) of sorted files."""
        number, checks = {r: i for i, r in enumerate(refs)}, []
        ref, low, high = None, -1, 2**40
        for name, sign, value in self.tests:
            if name == "ref":
                if sign == "==":
                    ref = number.get(value, -2)
                    checks.append(lambda r, p, f, q, v=ref: r == v)
            elif name == "strand":
                if sign == "==":
                    checks.append(lambda r, p, f, q, v=value: ("-" if f & 16 else "+") == v)
            else:
                at = {"pos": 1, "flag": 2, "mapq": 3}[name]
                compare = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[sign]
                checks.append(lambda *x, at=at, v=value, compare=compare: compare(x[at], v))
                if name == "pos":
                    low = max(low, value) if sign in ("==", ">", ">=") else low
                    high = min(high, value) if sign in ("==", "<", "<=") else high
        return (lambda *x: all(c(*x) for c in checks)), None if ref is None or ref < 0 else ((ref, low), (ref, high))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(part):
            held.append(row)
            if len(held) == ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def rows(self, part: Part) -> Iterator[tuple]:
        with opened(part.path) as file:
            head = header_of(file)
            test, span = self._wanted(head.refs)
            span = span if head.is_sorted else None
            start = first_block(file, part.low) if part.low else head.block
            if start is None or start >= part.high and part.low:
                return
            if span and part.high < file.size():  # sorted: what begins the next part lies behind all of this one
                peek = next(self._records(file, head, part.high, file.size()), None)
                if peek is not None and 0 <= peek[0] and peek[:2] < span[0]:
                    return
            for ref, pos, data in self._records(file, head, part.low, part.high):
                if span and (ref < 0 or (ref, pos) > span[1]):
                    return
                _, _, n_name, mapq, _, n_cigar, flag, n_seq, ref2, pos2, length = struct.unpack_from("<iiBBHHHiiii", data, 0)
                if not test(ref, pos, flag, mapq):
                    continue
                at = 32 + n_name
                codes = struct.unpack_from(f"<{n_cigar}I", data, at)
                tags = tags_of(data[at + 4 * n_cigar + (n_seq + 1) // 2 + n_seq :])
                if "CG" in tags and n_cigar == 2:  # more operations than fit into the field
                    codes = tuple(map(int, tags.pop("CG").split(",")[1:]))
                named = lambda r: head.refs[r] if 0 <= r < len(head.refs) else None
                yield (data[32 : 31 + n_name].decode("latin-1"), flag, named(ref), pos, mapq, cigar_of(codes), len(codes), "-" if flag & 16 else "+", n_seq, named(ref2), pos2, length, list(tags.items()))

    @staticmethod
    def _records(file, head: Header, low: int, high: int) -> Iterator[tuple[int, int, bytes]]:
        """(ref number, pos, record) of the records that begin in blocks that begin in [low, high)."""
        start = first_block(file, low) if low else head.block
        if start is None or start >= high:
            return
        start = max(start, head.block)
        blocks = Blocks(file, start)
        data = b""
        edges: list[tuple[int, int]] = []  # (place in data, place in file) of the blocks held

        def more() -> bool:
            nonlocal data
            got = blocks.next()
            if got is None:
                return False
            edges.append((len(data), got[0]))
            data += got[1]
            return True

        at = None
        if start == head.block:
            more()
            at = head.offset
        else:
            ended = False
            while at is None:
                ended = not more() or not more()
                at = first_record(data, len(head.refs), ended)
                if at is None and (ended or edges[-1][1] >= high and len(data) > 1 << 24):
                    if ended and not data.strip(b"\0"):
                        return
                    if ended:
                        return
                    raise ValueError(f"no record found from byte {low} on")
        while True:
            while len(data) < at + 4 and more():
                pass
            if len(data) < at + 4:
                return
            here = next(f for d, f in reversed(edges) if d <= at)
            if here >= high:
                return
            size = struct.unpack_from("<i", data, at)[0]
            while len(data) < at + 4 + size and more():
                pass
            if len(data) < at + 4 + size:
                raise ValueError("the file ends within a record")
            record = data[at + 4 : at + 4 + size]
            yield (*struct.unpack_from("<ii", record, 0), record)
            at += 4 + size
            if at > 1 << 20:  # let go of what has been read
                keep = max(i for i, (d, _) in enumerate(edges) if d <= at)
                cut = edges[keep][0]
                data, at, edges = data[cut:], at - cut, [(d - cut, f) for d, f in edges[keep:]]


class Alignments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def read_alignments(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The records of the files; filters are pushed down, which has to be asked for in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Alignments)
    return spark.read.format("alignments").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_positions(records: DataFrame, ref: str, start: int, end: int, tags: str | list[str] | None = None, strand: str | None = None, ungapped: bool = False, min_reads: int = 0) -> DataFrame:
    """(stratum, pos) of the reads that begin in start..end of a reference, in strata of more than ``min_reads`` reads.

    A stratum is the value of a tag, or of several joined by commas; reads without one of them (or with an empty only value) are
    left out; without tags all reads are one stratum, All. ``ungapped`` asks for a cigar of one operation.
    """
    r = records.where((F.col("ref") == ref) & (F.col("pos") >= start) & (F.col("pos") <= end))
    if strand:
        r = r.where(F.col("strand") == strand)
    if ungapped:
        r = r.where("n_cigar = 1")
    names = [tags] if isinstance(tags, str) else tags or []
    values = [F.element_at("tags", t) for t in names]
    if values:
        stratum = F.concat_ws(",", *values)
        for v in values:
            r = r.where(v.isNotNull())
        r = r.where(stratum != "")
    else:
        stratum = F.lit("All")
    r = r.select(stratum.alias("stratum"), "pos")
    return r.withColumn("n", F.count("*").over(Window.partitionBy("stratum"))).where(F.col("n") > min_reads).drop("n")
