"""Hard negatives, packing and conversation repair against brute force."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest

from loculus.llm import negatives, packing, repair

RNG = np.random.default_rng(11)
EMB = "vec_id long, embedding array<float>, label int, extra string"


def mined(rows, low, high, positives=5, found=10, step=5):
    """All pairs, in plain integers."""
    ok = {}
    for i, v, y, _ in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = True
    ok = list(ok)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, y, v in ok:
        if a % step:
            continue
        every = sorted((-dot(v, w), i, z) for i, z, w in ok)
        for s, p, _ in [t for t in every if t[2] == y and t[1] != a][:positives]:
            hits = [t for t in every if t[2] != y and low * -s <= 100 * -t[0] <= high * -s][:found]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def cloud(n, dim, labels, copies=0):
    rows = [(i, [float(x) for x in RNG.normal(size=dim).astype(np.float32)], int(RNG.integers(labels)), "x") for i in range(n)]
    return rows + [(n + i, rows[0][1], rows[i % 3][2], "copy") for i in range(copies)]


@pytest.mark.parametrize("case", ["plain", "copies and ties", "odd rows", "few", "wide range"])
def test_hard_negatives(spark, case, monkeypatch):
    low, high, pivots = 30, 90, 4
    if case == "plain":
        rows = cloud(120, 6, 3)
    elif case == "copies and ties":
        rows = cloud(60, 2, 2, 90) + [(500 + i, [float(i % 3), 1.0], i % 2, "tie") for i in range(60)]
        rows += rows[:40]  # rows that repeat
    elif case == "odd rows":
        rows = cloud(40, 3, 2) + [(None, [1.0, 2.0, 3.0], 1, ""), (100, None, 1, ""), (101, [1.0, None, 2.0], 0, ""), (105, [1.0, float("nan"), 2.0], 0, ""), (110, [1.0, float("inf"), 0.0], 1, ""), (115, [0.5, 0.5, 0.5], None, "")]
        rows += [(120, [], 0, "empty"), (125, [1.0], 1, "short"), (130, [0.1, 0.2, 0.3, 4.0], 0, "long"), (130, [0.3, 0.2, 0.1], 1, "id again"), (135, [3e5, 2.0, 1.0], 0, "large")]
    elif case == "few":
        rows = [(0, [1.0], 0, ""), (5, [0.5], 1, ""), (1, [0.9], 0, "")]
    else:
        rows, low, high = cloud(90, 4, 3), -1000, 1000
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "SEGMENT_BYTES", 64)  # many segments
    df = spark.createDataFrame(rows, EMB).repartition(3)
    got = negatives.mine(df, df.vec_id % 5 == 0, 256, 5, 10, low, high, pivots)
    assert sorted(map(tuple, got.collect())) == mined(rows, low, high)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], EMB)
    assert negatives.mine(df, df.vec_id % 5 == 0, 256, 5, 10, 30, 90).count() == 0
    df = spark.createDataFrame([(1, [1.0], 0, "")], EMB)
    assert negatives.mine(df, df.vec_id % 5 == 0, 256, 5, 10, 30, 90).count() == 0
    df = spark.createDataFrame([(5, [3e38], 0, "")], EMB)
    with pytest.raises(Exception, match="64-bit"):
        negatives.mine(df, df.vec_id % 5 == 0, 256, 5, 10, 30, 90).count()


def placed(plan, histogram):
    """Fills by sequence after checks: gapless sequences, each item whole."""
    at = collections.defaultdict(list)
    for w, n in histogram.items():
        for r in range(n if w else 0):
            pieces = plan.pieces(w, r)
            assert [p[2] for p in pieces] == list(itertools.accumulate([0, *[p[3] for p in pieces[:-1]]])) and sum(p[3] for p in pieces) == w
            for s, place, _, m in pieces:
                at[s].append((place, m))
    fills = {}
    for s, v in at.items():
        end = 0
        for place, m in sorted(v):
            assert place == end
            end += m
        fills[s] = end
    assert set(fills) == set(range(plan.sequences))
    return fills


@pytest.mark.parametrize("name,lengths", [("one", [5]), ("none", []), ("full only", [0, 0]), ("alike", [700] * 1000), ("two", [1100] * 40 + [900] * 60), ("halves", [1024] * 7), ("large", [2047] * 50), ("mixed", list(np.clip(RNG.lognormal(5.8, 1.1, 3000).astype(int), 1, 2047))), ("small", list(RNG.integers(1, 9, 500)))])
def test_plans(name, lengths):
    h = collections.Counter(map(int, lengths))
    plan = packing.Plan(dict(h), 2048)
    fills = placed(plan, h)
    tokens = sum(fills.values())
    padding = sum(packing.padded(n, 2048) - n for n in fills.values())
    assert tokens == sum(lengths) and all(n <= 2048 for n in fills.values())
    if name not in ("large", "alike", "two"):
        assert padding <= 0.01 * tokens + 64, (padding, tokens)
    assert len(fills) <= 1.05 * tokens / 2048 + 14 or name in ("large", "alike", "two")


def test_the_program_is_better_than_the_fill_it_begins_with():
    h = {1000: 300, 700: 300, 400: 300, 348: 300, 648: 300}
    w, d = np.array(sorted(h)), np.array([h[k] for k in sorted(h)])
    cost = lambda found: sum((packing.padded(sum(int(w[i]) * n for i, n in p.items()), 2048) + 1) * t for p, t in found)
    begun, solved = packing._filled(w, d, 2048), packing.solve(w, d, 2048)
    for found in (begun, solved):
        have = np.zeros(len(w))
        for p, t in found:
            for i, n in p.items():
                have[i] += n * t
        assert have == pytest.approx(d, abs=1e-6)
    assert cost(solved) < cost(begun) - 100


def test_packed_documents(spark):
    pytest.importorskip("tiktoken")
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(None, "a <|endoftext|> b<|endoftext|>"), (9001, None), (9002, ""), (9003, "word " * 30_000), (9003, "word " * 30_000), (9004, "é漢字😀\x85  x's  \n"), (9005, "a" * 50_000)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("ids", docs.text).repartition(3)
    args = (public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {"<|endoftext|>": 50256}, 1, 2048)
    got = packing.pack(df, *args).collect()
    tk = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = collections.Counter()
    rows = [(r.doc_id, np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in df.collect()]
    by, fills = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        fills[r.sequence_id].append((r.offset, r.length))
    for i, ids in rows:
        want[i] += len(ids)
        for r in by[i]:
            if r.doc_tokens == len(ids):
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert {i: sum(r.length for r in v) for i, v in by.items()} == dict(want)
    for i, ids in rows:
        spans = collections.Counter((r.start, r.length) for r in by[i])
        copies = sum(j == i for j, _ in rows)
        covered = collections.Counter(x for (s, n), k in spans.items() for x in range(s, s + n) for _ in range(k))
        assert set(covered) == set(range(len(ids))) and set(covered.values()) == {copies}
    pad = 0
    for v in fills.values():
        end = 0
        for place, n in sorted(v):
            assert place == end
            end += n
        assert end <= 2048
        pad += packing.padded(end, 2048) - end
    assert pad <= 0.01 * sum(want.values())
    assert packing.pack(df.limit(0), *args).count() == 0


CONV = "conv_id long, turn long, role string, text string, extra string"


def repaired(rows):
    """A plain table of the best (cost, audit) by state after each row."""
    said = lambda v: " " if v is None else str(v)
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        k, held = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, by[c]
        r, x = said(r), said(x)
        x = "" if k == 1 else "".join(q for q in x if q not in ".!?") if k == 2 else x
        if k:
            held += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    ahead = {"": "u", "s": "u", "u": "a", "a": "u"}
    out = {}
    for c, v in by.items():
        damaged_role = {}
        v.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
        del damaged_role
        seen, faults = set(), []
        for _, r, x in v:
            y = x.strip(" \t\n\v\f\r")
            faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "")
            seen.add((r, x))

        def filled(best):
            for _ in range(4):
                for s, (k, a) in list(best.items()):
                    best[ahead[s]] = min(best.get(ahead[s], (math.inf, "")), (k + 5, a + "I"))
            return best

        best = {"": (0, "")}
        for (_, r, _), q in zip(v, faults, strict=True):
            new = {}
            for s, (k, a) in filled(best).items():
                steps = [(s, k + 2, a + "D")]
                if q not in ("b", "d"):
                    e = 5 * (q == "t")
                    steps.append((ahead[s], k + 1 + e, a + "R"))
                    if r[:1] == ahead[s] or (r[:1] == "s" and s == ""):
                        steps.append((r[:1], k + e, a + "K"))
                for z, *w in steps:
                    new[z] = min(new.get(z, (math.inf, "")), tuple(w))
            best = new
        cost, audit = min(x for s, x in filled(best).items() if s in ("", "a"))
        s, i, kept = "", 0, []
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = v[i][1] if e == "K" else {"u": "user", "a": "assistant"}[ahead[s]]
            kept.append(f"{role}:{'' if e == 'I' else v[i][2]}")
            s, i = role[:1], i + (e != "I")
        turns = [t for t, _, _ in v if t is not None]
        first = [r[:1] for _, r, _ in v]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def talk(conv, n, roles=("system", "user", "assistant", "tool", "", None), texts=("A.", "b", "", " \t", "Yes!", "no?  ", None, "x" * 50 + ".")):
    pick = lambda xs: xs[int(RNG.integers(len(xs)))]
    return [(conv, None if RNG.random() < 0.05 else int(RNG.integers(3 * n)), pick(roles), pick(texts), "e") for _ in range(n)]


@pytest.mark.parametrize("chunk", [512, 3])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = [r for c in range(40) for r in talk(c, int(RNG.integers(1, 9)))]
    rows += talk(None, 6) + [(77, 5, "user", f"{k}.", "e") for k in range(20)] + [(78, k, "assistant", f"{k}.", "e") for k in range(60)] + talk(79, 150)
    rows += [(80, 3, "user", "Same.", "e")] * 25 + [(c, t, "user", "Hi.", "e") for c in range(200, 260) for t in range(1)]  # some lose all their rows
    rows += [(81, k, ("user", "assistant")[k % 2], f"Turn {k}.", "e") for k in range(120)]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, CONV).repartition(5))).collect()
    want = repaired(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(w[6] == "" and w[5] == 0 for w in want.values()) and len({len(w[6]) for w in want.values()}) > 5


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], CONV))).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_search_is_cheapest_from_every_state(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 6))
    initials, faults = [str(rng.choice(list("suat") + [""])) for _ in range(n)], [int(rng.integers(-1, 3)) for _ in range(n)]
    for start in range(4):
        want: dict = {}

        def walk(i, state, cost, audit, inserted):
            if i == n and not audit.endswith("I"):
                want[state] = min(want.get(state, (math.inf, "")), (cost, audit))  # noqa: B023
            if i == n:
                return
            made = repair.NEXT[state][1]
            if inserted < 2:
                walk(i, made, cost + 5, audit + "I", inserted + 1)
            walk(i + 1, state, cost + 2, audit + "D", 0)
            if faults[i] not in (0, 1):
                charge = 5 if faults[i] == 2 else 0
                walk(i + 1, made, cost + 1 + charge, audit + "R", 0)
                if (state, initials[i]) in repair.KEPT:
                    walk(i + 1, repair.KEPT[state, initials[i]], cost + charge, audit + "K", 0)

        walk(0, start, 0, "", 0)
        assert repair.cheapest(initials, faults, start, False) == want
