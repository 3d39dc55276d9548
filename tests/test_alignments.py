"""The data source of alignments against the rows that a test file was written from."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loculus.operators import features
from loculus.sources import alignments

REFS = ["chr1", "chr2", "chrM"]


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(z) + 25) + z + struct.pack("<II", zlib.crc32(data), len(data))


def record(r: dict) -> bytes:
    name = r["name"].encode() + b"\0"
    codes = b"".join(struct.pack("<I", n << 4 | alignments.OPERATIONS.index(o)) for n, o in r["cigar"])
    tags = b""
    for k, v in r["tags"].items():
        tags += k.encode() + (b"Z" + v.encode() + b"\0" if isinstance(v, str) else b"i" + struct.pack("<i", v) if isinstance(v, int) else b"f" + struct.pack("<f", v) if isinstance(v, float) else b"BS" + struct.pack(f"<i{len(v)}H", len(v), *v))
    n = r["length"]
    body = struct.pack("<iiBBHHHiiii", r["ref"], r["pos"], len(name), r["mapq"], 4680, len(r["cigar"]), r["flag"], n, -1, -1, 0) + name + codes + bytes((n + 1) // 2) + b"\x20" * n + tags
    return struct.pack("<i", len(body)) + body


def file_of(path, rows, size, order="unsorted"):
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 10**6) for r in REFS)
    data = head + b"".join(map(record, rows))
    with open(path, "wb") as f:  # records lie across the blocks
        for at in range(0, len(data), size):
            f.write(block(data[at : at + size]))
        f.write(block(b""))


def reads(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ref = rnd.choice([0, 0, 1, 2, -1])
        cigar = rnd.choice([[(50, "M")], [(20, "M"), (5, "I"), (25, "M")], [(10, "S"), (40, "M")]]) if ref >= 0 else []
        tags = {k: v for k, v in {"CB": f"cell{rnd.randint(0, 4)}", "XO": rnd.choice(["a", "b", ""]), "NH": rnd.randint(-3, 70000), "ZF": 1.5, "ZB": [1, 2, 65535]}.items() if rnd.random() < 0.8}
        out.append({"name": f"read{i}", "flag": rnd.choice([0, 16, 4]), "ref": ref, "pos": rnd.randint(0, 5000) if ref >= 0 else -1, "mapq": rnd.randint(0, 60), "cigar": cigar, "length": rnd.choice([0, 51, 50, 3000 if i % 97 == 0 else 20]), "tags": tags})
    return out


def said(r):
    text = lambda v: ",".join(["S", *map(str, v)]) if isinstance(v, list) else str(v)
    return (r["name"], r["flag"], REFS[r["ref"]] if r["ref"] >= 0 else None, r["pos"], r["mapq"], "".join(f"{n}{o}" for n, o in r["cigar"]) or None, "-" if r["flag"] & 16 else "+", r["length"], tuple(sorted((k, text(v)) for k, v in r["tags"].items())))


def got(df):
    return sorted((r.name, r.flag, r.ref, r.pos, r.mapq, r.cigar, r.strand, r.length, tuple(sorted(r.tags.items()))) for r in df.collect())


@pytest.mark.parametrize("size", [300, 5000, 60_000])
def test_parts_give_the_rows_once(spark, tmp_path, size):
    rows = reads(1500, size)
    path = str(tmp_path / "x.bam")
    file_of(path, rows, size)
    want = sorted(map(said, rows))
    for parts in (1, 7, 40):
        df = alignments.read_alignments(spark, path, parts=parts)
        assert df.rdd.getNumPartitions() == parts
        assert got(df) == want
    assert got(alignments.read_alignments(spark, str(tmp_path), partBytes=20_000)) == want


@pytest.mark.parametrize("order", ["unsorted", "coordinate"])
def test_filters(spark, tmp_path, order):
    rows = reads(2000, 3)
    if order == "coordinate":
        rows.sort(key=lambda r: (r["ref"] if r["ref"] >= 0 else 99, r["pos"]))
    path = str(tmp_path / "x.bam")
    file_of(path, rows, 2000, order)
    df = alignments.read_alignments(spark, path, parts=9)
    tests = {
        "ref = 'chr1' AND pos >= 1000 AND pos <= 1500": lambda r: r["ref"] == 0 and 1000 <= r["pos"] <= 1500,
        "ref = 'chr2' AND strand = '-' AND mapq > 30": lambda r: r["ref"] == 1 and r["flag"] & 16 and r["mapq"] > 30,
        "pos < 100 AND tags['CB'] = 'cell1'": lambda r: r["pos"] < 100 and r["tags"].get("CB") == "cell1", "ref = 'chrX'": lambda r: False, "ref IS NULL": lambda r: r["ref"] < 0,
    }
    for where, test in tests.items():
        assert got(df.where(where)) == sorted(said(r) for r in rows if test(r)), where


def test_sorted_parts_are_skipped(tmp_path):
    rows = sorted(reads(2000, 4), key=lambda r: (r["ref"] if r["ref"] >= 0 else 99, r["pos"]))
    path = str(tmp_path / "x.bam")
    file_of(path, rows, 2000, "coordinate")
    reader = alignments.AlignmentReader({"path": path, "parts": 20})
    reader.tests = [("ref", "==", "chr1"), ("pos", ">=", 2000), ("pos", "<=", 2100)]
    seen = [0]
    plain = alignments.tags_of

    def counted(data):
        seen[0] += 1
        return plain(data)

    alignments.tags_of = counted
    try:
        found = [r for p in reader.partitions() for r in reader.rows(p)]
    finally:
        alignments.tags_of = plain
    assert len(found) == seen[0] == sum(r["ref"] == 0 and 2000 <= r["pos"] <= 2100 for r in rows)


def test_read_positions_feed_the_score(spark, tmp_path):
    rows = reads(1500, 5)
    path = str(tmp_path / "x.bam")
    file_of(path, rows, 3000)
    df = alignments.read_alignments(spark, path, parts=5)
    near = [r for r in rows if r["ref"] == 0 and 500 <= r["pos"] <= 4000]
    count = lambda df: sorted((r.stratum, r.pos) for r in df.collect())
    assert count(alignments.read_positions(df, "chr1", 500, 4000)) == sorted(("All", r["pos"]) for r in near)
    one = [r for r in near if not r["flag"] & 16 and len(r["cigar"]) == 1 and r["tags"].get("XO")]
    assert count(alignments.read_positions(df, "chr1", 500, 4000, "XO", "+", True)) == sorted((r["tags"]["XO"], r["pos"]) for r in one)
    both = [(f"{r['tags']['CB']},{r['tags']['XO']}", r["pos"]) for r in near if "CB" in r["tags"] and "XO" in r["tags"]]
    many = {s for s, _ in both if sum(t == s for t, _ in both) > 17}
    assert many and count(alignments.read_positions(df, "chr1", 500, 4000, ["CB", "XO"], min_reads=17)) == sorted(x for x in both if x[0] in many)
    scores = {r.stratum: r.score for r in features.read_position_score(alignments.read_positions(df, "chr1", 500, 4000, "CB"), "stratum", "pos").collect()}
    assert set(scores) == {f"cell{k}" for k in range(5)} and all(-1 <= s <= 1 for s in scores.values())


def test_other_files(spark, tmp_path):
    file_of(tmp_path / "empty.bam", [], 100)
    assert alignments.read_alignments(spark, str(tmp_path / "empty.bam"), parts=3).count() == 0
    (tmp_path / "no.bam").write_bytes(b"not such a file")
    with pytest.raises(Exception, match="no block"):
        alignments.read_alignments(spark, str(tmp_path / "no.bam")).select(F.count("*")).collect()
