"""Automata, local parsers, scores and encodings against plain implementations."""

import base64
import hashlib
import random
import re
import time

import pandas as pd
import pytest

from loculus.llm import bpe, pii, toxicity, urlfilter

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public.path("byte_bpe_50k.tiktoken")
HARD = ["", "a" * 3000, "the 日本語 <|endoftext|>  \n\n x", "\U0001f600" * 200, "don't   stop\t\r\n", "é" * 77, "0123456789" * 30, "\x00\x01", "abab" * 500]


def test_bpe_equals_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = HARD + ["".join(rnd.choice("ab cdeé\n.1日") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    b = bpe.Bpe(ranks, public.PATTERN, keep=50)
    for t, (n, ids, back) in zip(texts, b.digests(texts, chars=500), strict=True):
        want = enc.encode_ordinary(t)
        assert (n, ids, back) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert b.encode(t) == want
    df = spark.createDataFrame([(1, "hello world", 5), (None, None, 6), (9007199254740993, "x", 7)], "doc_id long, text string, ids int")
    rows = bpe.round_trip(df, PATH, public.PATTERN).collect()
    assert [r.doc_id for r in rows] == [1, None, 9007199254740993] and rows[1].n_tokens == 0
    e = bpe.encode_documents(df, PATH, public.PATTERN)
    assert [bytes(r.decoded).decode() for r in bpe.decode_documents(e, PATH, public.PATTERN).collect()] == ["hello world", "", "x"]
    assert bpe.round_trip(df.limit(0), PATH, public.PATTERN).count() == 0


def test_bpe_of_a_piece_beyond_4_mib():
    merged = [b"ab", b"bc", b"abc", b"abcab", b"cc"]
    ranks = {bytes([b]): b for b in range(256)} | {m: 256 + i for i, m in enumerate(merged)}

    def plain(s):
        p = [s[i : i + 1] for i in range(len(s))]
        while best := min(((ranks[p[i] + p[i + 1]], i) for i in range(len(p) - 1) if p[i] + p[i + 1] in ranks), default=None):
            p[best[1] : best[1] + 2] = [p[best[1]] + p[best[1] + 1]]
        return [ranks[x] for x in p]

    parts = [b"abcab", b"ccc", b"babc", b"abab", b"bcc"]
    gap = (1 << 22) // (len(parts) - 1)
    piece = (b"x" * gap).join(parts)
    assert len(piece) > 1 << 22
    want = [i for k, s in enumerate(parts) for i in [ord("x")] * (gap if k else 0) + plain(s)]
    assert bpe.Bpe(ranks, r"\p{L}+").merge([piece]) == [want]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]


ANCHORS = ["a://", "a:// @", "a://b/user", "token=", "token=.-/", "secret is ", "account 1", "account no.", "iban ", "x@", "x@a.", "+1 ", "+1+", "1.", "4 ", "1.2.3.4."]


@pytest.mark.parametrize("anchor", ANCHORS)
def test_time_is_linear_in_a_text_of_anchors(anchor):
    """1 MB of one anchor; a parser that starts anew at each would take hours."""
    began = time.time()
    spans = pii.find_spans(anchor * (1_000_000 // len(anchor)))
    assert time.time() - began < 60
    assert all(0 <= s < e <= 1_000_000 for _, s, e in spans)


def test_users_and_values():
    text = "see http://u@h.x/a, ftp://h/~me. token=abc12345 and token= token=; account no. 12345678, http://plain.org/x"
    said = [(k, text[s:e]) for k, s, e in pii.find_spans(text) if k not in PATTERNS]
    assert said == [("url", "http://u@h.x/a"), ("url", "ftp://h/~me"), ("account", "12345678"), ("secret", "abc12345")]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert pii.redact(empty).count() == pii.detect(empty).count() == pii.digests(empty).count() == 0


def test_spans_equal_patterns(spark):
    rnd = random.Random(2)
    bits = ["1", "22", "@", "a", ".", "-", " ", "+", "(", "255", "é", "4111111111111111", "b@c.d", "+1 (234) 555-1234", ":", "_", "10.0.0.1"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(8000)]
    for t in texts:
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]
        assert [s for s in pii.find_spans(t) if s[0] in PATTERNS] == want, t
    df = spark.createDataFrame([(1, "mail a@b.co now", 3), (2, None, 4), (None, "", 5)], "doc_id long, text string, spans int")
    assert [r.text for r in pii.redact(df).collect()] == ["mail <email> now", None, ""]
    assert [r.n_email for r in pii.digests(df).collect()] == [1, 0, 0]
    assert [len(r.spans) for r in pii.detect(df).collect()] == [1, 0, 0]


def test_added_kinds():
    t = 'see https://bob:pw1@host.example/x, account no: DE12345678, token = "ab12cd34ef" and http://host.example/plain'
    assert [(k, t[s:e]) for k, s, e in pii.find_spans(t) if k in ("url", "account", "secret")] == [("url", "https://bob:pw1@host.example/x"), ("account", "DE12345678"), ("secret", "ab12cd34ef")]
    assert pii.mask("a 10.0.0.1 b", [("ip", 2, 10), ("card", 4, 6)]) == "a <ip> b"


def glob_regex(g):
    out, i = "", 0
    while i < len(g):
        if g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return re.compile(out, re.S)


def test_globs():
    rnd = random.Random(3)
    for _ in range(60):
        globs = ["".join(rnd.choice("ab/*?*") for _ in range(rnd.randint(0, 9))) for _ in range(40)]  # over one word of bits
        urls = ["".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 10))) for _ in range(30)]
        m = urlfilter.GlobAutomaton(globs).match([u.encode() for u in urls])
        assert [[bool(x) for x in row] for row in m] == [[bool(glob_regex(g).fullmatch(u)) for g in globs] for u in urls]


def test_url_rules(spark):
    R = urlfilter.Rule
    rules = [R("com", "/", "allow"), R("example.com", "/en/", "block"), R("www.example.com", "/en/", "allow")]
    urls = {"http://EXAMPLE.com/en/a?q": "block", "http://www.example.com/en/": "allow", "http://notexample.com/en/": "allow", "http://example.com": "allow", "http://x.org/login": "block", "http://a.net/x.com/": "allow", "no scheme": "allow", None: "allow", "://": "allow"}
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = urlfilter.judge(df, rules, ["**/login**"]).collect()
    assert [r.verdict for r in got] == list(urls.values())
    assert [r.rule for r in got][:4] == ["example.com/en/", "www.example.com/en/", "com/", None]
    assert urlfilter.judge(df.limit(0), rules, []).count() == 0


def test_canonical_urls_before_globs(spark):
    """Spellings of one place get the same verdict; host and path come out as written."""
    spelled = ["http://x.org/login", "http://x.org/%6Cogin", "http://x.org/Login", "http://x.org//login", "http://x.org/x/../login", "https://x.org:443/login", "http://u:p@x.org/./login", "http://x.org./%4c%6fgin"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(spelled)], "page_id long, url string")
    got = urlfilter.judge(df, [], ["*.x.org/login"]).orderBy("page_id").collect()
    assert [(r.verdict, r.pattern) for r in got] == [("block", "*.x.org/login")] * len(spelled)
    assert (got[1].path, got[5].host, got[2].path) == ("/%6Cogin", "x.org:443", "/Login")
    same = {"http://h/%2Flogin": ".h/%2flogin", "http://h/%%36c": ".h/%6c", "http://h": ".h/", "http://h/..": ".h/", "http://h/a/..": ".h/", "http://h/a/b/..": ".h/a/", "http://h:80a/": ".h:80a/", "https://h:80/": ".h:80/", "ftp://h:/b//": ".h/b/", "http://h/.well": ".h/.well", "x": ""}
    assert {u: urlfilter.canonical(u, *urlfilter.split_url(u)) for u in same} == same


def test_canonical_urls_against_sql(spark):
    import duckdb

    from loculus.llm import queries, sql

    rnd = random.Random(4)
    parts = ["/", "/", "//", "/.", "/..", "login", "Ads", "%6C", "%2f", "%", "ogin", "a", "é", "?q", "#f", "://", ".", "@", ":80", ":443", ":", "cart", "\n"]
    urls = [rnd.choice(["http://", "HTTPS://", "ftp://", "", "://"]) + rnd.choice(["x.com", "Ads.net", "www.example.com", "example.net.", "u@x.org:443", "x.org:80", "%61ds.org", ""]) + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(1500)]
    rows = [(i, u) for i, u in enumerate([*urls, None, ""])]
    pages = pd.DataFrame(rows, columns=["page_id", "url"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = {r[0]: r[1:] for r in con.sql(f"SELECT page_id, host, path, rule, verdict, pattern FROM ({sql.op3()})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES, queries.BLOCKED).collect()}
    assert {i: (rows[i][1], got[i], want[i]) for i in got if got[i] != want[i]} == {} and len(got) == len(want) == len(rows)
    assert len({v[4] for v in got.values()}) > 3


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def test_levenshtein_trie():
    rnd = random.Random(4)
    terms = ["idiot", "moron", "ab", "disgusting", "worthless", "stupid", "stupor"]
    dfa = toxicity.LexiconAutomaton(terms, limit=100)
    for _ in range(4000):
        t = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randint(0, max(0, len(t) - 1))
            t[p : p + rnd.choice([0, 1])] = rnd.choice(["", "a", "d", "i", "o", "t", "s"])
        w = "".join(t)
        assert dfa.match(w) == min(((lev(w, x), i) for i, x in enumerate(terms) if lev(w, x) <= toxicity.allowed(x)), default=None)


def test_toxicity(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["blorg", "Zanktor,", "grumplex"])
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "blorg", 0.0), (1002, "you are a grumplx", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity.train(df, lab.where(~toxicity.held_out()), min_toxic=2)
    s = {r.doc_id: r.score for r in toxicity.score(df, m).collect()}
    assert all((s[i] >= 0.5) == bool(t) for i, t in labels)
    assert s[1000] == s[1001] < 0.5 <= s[1002]
    kept = toxicity.keep_clean(df, m)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t in labels if not t} | {1000, 1001}
    assert toxicity.train(df, lab.limit(0)).terms == list(toxicity.SEED)
    quoted, plain = (m_.features(t)[0] for m_, t in ((toxicity.Matcher(m), 'the word "blorg" was quoted'), (toxicity.Matcher(m), "you blorg")))
    assert quoted[0] < plain[0] and quoted[1] > plain[1]
