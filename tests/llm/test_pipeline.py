"""The stages one by one against plain versions, and the whole run; the entry without the corpus operators."""

import base64
import itertools
import os
import shutil
import subprocess
import sys

import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as cp
    from loculus.llm import pii, toxicity
    from loculus.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {}
    for name, f in cp.STAGES:
        docs = written(f(spark, docs, SF))
        out[name] = docs.collect()
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(~toxicity.held_out()))
    m = toxicity.Matcher(model)
    assert {r.doc_id for r in out["toxicity"]} == {i for i, r in source.items() if m.score(r.text) < 0.5}
    before, after = {r.doc_id: shingles(r.text) for r in out["toxicity"]}, {r.doc_id for r in out["minhash_near_dedup"]}
    up = {i: i for i in before}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sorted(before.items()), 2):
        n = len(a & b)
        if n and 100 * n >= 80 * (len(a) + len(b) - n):
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert after == {i for i in before if root(i) == i}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i in after if any(" ".join(b) in " ".join(source[i].text.lower().split()) for b in bench)}
    clean = {r.doc_id for r in out["benchmark_decontamination"]}
    assert leaks and not leaks & clean and len(after - clean) <= len(leaks) + 3
    assert {(r.doc_id, r.text, r.n_chars) for r in out["pii"]} == {(i, t, len(t)) for i in clean for t in [pii.mask(source[i].text, pii.find_spans(source[i].text))]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in out["pii"]}
    assert {(r.doc_id, r.n_tokens) for r in out["byte_bpe"]} == {(i, len(enc.encode_ordinary(t))) for i, t in text.items()}


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    n, ops, known = said.stdout.split()
    assert int(n) > 50 and (ops, known) == ("False", "True")
