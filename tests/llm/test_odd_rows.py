"""The pipeline's stages on rows with nulls, repeats, maps and clashing names, on long texts and on nothing; payloads that are odd."""

import gzip
import os
import zlib

import pytest
from pyspark.sql import functions as F

from loculus.llm import decontam, minhash, quality, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, meta map<string,string>, _least int, _row int, row int, mark string, d struct<k:int>"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_odd_rows(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    more = lambda i, t, m: (i, t, None, None, None if t is None else len(t), m, 1, 2, 3, "m", (1,))
    own = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    odd = [more(None, own, {"a": "1"}), more(None, None, None), more(9001, None, {}), more(9001, None, None), more(9002, "", {"b": None}), more(9003, own, {"x": "1", "y": "2"}), more(9003, own, {"y": "2", "x": "1"}), more(9003, own + " x", {"z": "3"}), more(9004, "word " * 40_000, None)]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars, {"k": "v"}, 1, 2, 3, "m", (1,)) for r in rows] + odd, SCHEMA).repartition(3)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == out.columns
        if name != "byte_bpe":
            assert out.columns == docs.columns
        got = out.collect()
        ids = [r.doc_id for r in got]
        assert ids.count(None) == 2 and {9001, 9002, 9003, 9004} <= set(ids), name
        if name == "minhash_near_dedup":
            assert ids.count(9001) == ids.count(9003) == 1
            assert next(r for r in got if r.doc_id == 9003).text == own
            assert all(isinstance(r.meta, dict | None) for r in got)
        else:
            assert ids.count(9003) == 3 and ids.count(9001) == 2


def test_representatives_of_rows_with_maps(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t, {"a": "b"}, 5), (1, t, {"a": "a"}, 4), (1, t + " z", {"c": "d"}, 3), (2, t, None, 1)]
    got = minhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>, _least int")).collect()
    assert [(r.doc_id, r.text, r.m, r._least) for r in got] == [(1, t, {"a": "a"}, 4)]


HTML = b"<p>hello</p>"


def text(payload, *heads, kind="text/html"):
    return warc.text_of(payload, "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: {kind}", *heads]))


def test_payloads(spark):
    assert text(gzip.compress(HTML) + gzip.compress(b"<p>two</p>"), "Content-Encoding: gzip") == "hello\ntwo"
    whole = gzip.compress(HTML * 50)
    assert warc.decompressed(whole[:-20], "gzip") == whole[:-20] and "hello" not in text(whole[:-20], "Content-Encoding: gzip")
    assert text(HTML, "Content-Encoding: gzip") == "hello"  # unpacked before
    assert text(gzip.compress(zlib.compress(HTML)), "Content-Encoding: deflate, gzip") == "hello"
    assert text(gzip.compress(HTML) + b"\0" * 20, "Content-Encoding: gzip") == "hello"
    assert text(b"\x8b\x02\x80", "Content-Encoding: br") == "" == text(b"", "Content-Encoding: br")
    zstandard = pytest.importorskip("zstandard")
    z = zstandard.compress(HTML)
    assert text(z + zstandard.compress(b"<p>b</p>"), "Content-Encoding: zstd") == "hello\nb" and warc.decompressed(z[:-3], "zstd") == z[:-3]


@pytest.mark.parametrize("payload,charset,want", [(b"a+2D0-b", "utf-7", "a�b"), (b"\\ud83d\\ude00 \\ud83d", "unicode_escape", "😀 �"), (b"\xff", "utf-8", "�"), (b"x", "hex", "x"), (b"x", "no-such", "x")])
def test_charsets_stop_no_job(spark, payload, charset, want):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset={charset}\r\n\r\n".encode() + payload
    df = spark.createDataFrame([("r", "response", "u", "d", {}, bytearray(block))], warc.RECORD)
    assert {r.warc_type: r.body for r in warc.derive(df).collect()}["conversion"] == want


def test_leak_in_a_long_text(spark):
    """An item many times over, and once far within a long text; the work follows the text's length."""
    item = " ".join(f"i{k}" for k in range(150))
    filler = " ".join(f"f{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, " ".join([item] * 60)), (2, f"{filler} {item} {filler}"), (3, filler)], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.similarity) for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (0, 1.0), 2: (20_000, 1.0)}


def test_cleaning_of_nothing_and_of_a_long_text(spark):
    long = "\n".join(f"This is line number {k} of a long text." for k in range(5000))
    df = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean(df).collect()}
    assert got[1].n_words == 45_000 and got[1].n_lines == 5000 and got[2].n_words == 0
    assert quality.clean(df.limit(0)).count() == 0


def test_scores_of_repeated_and_long_texts_and_of_nothing(spark):
    rows = [(k, f"{'you stupid idiot ' if k % 2 else 'a calm and kind '}text number {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    long = "calm words " * 30_000
    got = toxicity.score(spark.createDataFrame([(1, rows[1][1]), (1, rows[1][1]), (2, long), (3, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert len(got) == 4 and got[0].score == got[1].score > 0.5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, model).where(F.col("score").isNull()).count() == 0
