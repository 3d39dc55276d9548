"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, ``://`` and identifier cues. From each anchor a
deterministic local parser expands to the span's boundaries and validates it. No pattern is run over whole texts.

Kinds, in the order of the outcome: email, ip, card, phone (fixed grammars, leftmost and non-overlapping in each kind),
then url (an address that carries a user: user info or a user path), account (cue and identifier), secret (cue and value).

Each parser goes on where the last scan stopped, whether that gave a span or not, so the time is linear in the text.

Defined results: a null text is empty and has no spans; offsets are code points, the end exclusive; kinds may overlap
one another; texts are never cut, however long; repeated rows are judged each for itself; an empty table gives an empty
one; extra columns are ignored by ``detect`` and ``digests`` and kept as they are by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_column, map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>|\\^`{}")
VALUE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-")
USER_PATHS = ("/~", "/user/", "/users/", "/profile/", "/u/", "/@")
#: Cues of account identifiers and of secrets; each is looked for as written, capitalized and in capitals.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "passport", "ssn", "customer id", "user id")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "private_key")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                a.add_word(form, (kind, len(form)))
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for p in ats:
        s = p
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        if s == p or p < done:
            continue
        e = _domain(t, p + 1)
        if e:
            yield s, e
            done = e


def _domain(t: str, at: int) -> int:
    """End of a name of two labels or more that begins at a position; 0 if there is none."""
    n, labels, end = len(t), 0, 0
    while True:
        s = at
        while at < n and t[at] in LABEL:
            at += 1
        if at == s:
            break
        labels, end = labels + 1, at
        if at == n or t[at] != ".":
            break
        at += 1
    return end if labels > 1 else 0


def _runs(digits: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in digits:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def _ips(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and t[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(e - s <= 3 or not t[s:e].lstrip("0")[3:] for s, e in four) and all(int(t[s:e].lstrip("0") or "0") <= 255 for s, e in four):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _cards(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and t[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 13 <= n <= 19 and luhn("".join(t[s:e] for s, e in runs[i : j + 1])):
            yield runs[i][0], runs[j][1]
        i = j + 1


def _phones(t: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    n, done = len(t), 0
    for p in pluses:
        if p < done or p + 1 >= n or t[p + 1] not in DIGITS:
            continue
        j, last, digits = p + 2, 0, 1
        while j < n and t[j] in PHONE:
            if t[j] in DIGITS:
                digits += 1
                if j >= p + 3:
                    last = j
            j += 1
        if not last:
            continue
        done = last + 1
        if 9 <= digits <= 15:
            yield p, done


def _urls(t: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    """Addresses that carry a user. What holds for a whole run of characters is found once a run, not once an anchor."""
    done = stop = trimmed = last_path = 0
    for end in ends:
        s = end - 2
        while s > done and t[s - 1] in SCHEME:
            s -= 1
        while s < end - 2 and not (t[s].isascii() and t[s].isalpha()):
            s += 1
        if s >= end - 2 or s < done:
            continue
        if end >= stop:
            stop = end + 1
            while stop < len(t) and t[stop] not in URL_END:
                stop += 1
            trimmed = stop
            while trimmed > end + 1 and t[trimmed - 1] in ".,;:!?)]":
                trimmed -= 1
            last_path = max(t.rfind(x, end + 1, trimmed) for x in USER_PATHS)
        e = max(trimmed, end + 1)
        slash = t.find("/", end + 1, e)
        host_end = e if slash < 0 else slash
        at = t.rfind("@", end + 1, host_end)
        if 0 <= at < host_end - 1 or (host_end > end + 1 and 0 <= slash <= last_path):
            yield s, e
            done = e


def _valued(t: str, cues: list[tuple[int, int]], kind: str) -> Iterator[tuple[int, int]]:
    """The value behind a cue: blanks, one of ``= : #`` or the words no, number, is; a quote; then value characters.

    A run of value characters is read once, however many cues lie in it.
    """
    done = stop = trimmed = 0
    last_digit = last_letter = -1
    n = len(t)
    for start, p in cues:
        if start < done or (start and t[start - 1].isalnum()) or (p < n and t[p].isalpha()):
            continue
        marked = False
        while p < n and t[p] in " \t":
            p += 1
        for word in ("number", "no.", "no", "is"):
            if t.startswith(word, p) and not t[p + len(word) : p + len(word) + 1].isalpha():
                p, marked = p + len(word), True
                break
        while p < n and t[p] in " \t:=#\"'":
            marked |= t[p] in ":=#"
            p += 1
        if p >= stop:
            stop, last_digit, last_letter = p, -1, -1
            while stop < n and t[stop] in VALUE:
                if t[stop] in DIGITS:
                    last_digit = stop
                elif t[stop].isalpha():
                    last_letter = stop
                stop += 1
            trimmed = stop
            while trimmed > p and t[trimmed - 1] in ".-/":
                trimmed -= 1
        e = max(trimmed, p)
        if marked and (_account(t, p, e) if kind == "account" else e - p >= 8 and last_digit >= p and last_letter >= p):
            yield p, e
            done = e


def _account(t: str, p: int, e: int) -> bool:
    return 6 <= e - p <= 34 and sum(c in DIGITS for c in t[p:e]) >= max(4, (e - p) // 2)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as in KINDS, then start."""
    t = text or ""
    at: dict[str, list] = {"at": [], "digit": [], "plus": [], "scheme": [], "account": [], "secret": []}
    for end, (kind, n) in AUTOMATON.iter(t):
        at[kind].append((end + 1 - n, end + 1) if kind in ("account", "secret") else end)
    if not any(at.values()):
        return []
    runs = _runs(at["digit"])
    found = {
        "email": _emails(t, at["at"]),
        "ip": _ips(t, runs),
        "card": _cards(t, runs),
        "phone": _phones(t, at["plus"]),
        "url": _urls(t, at["scheme"]),
        "account": _valued(t, sorted(at["account"]), "account"),
        "secret": _valued(t, sorted(at["secret"]), "secret"),
    }
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first and longest stays."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, spans as an array of (kind, start, end)."""
    make = lambda: lambda texts: (([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)],) for t in texts)
    return map_rows(docs, [key], [text], make, "spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the text with its spans masked; a null text stays null."""
    return map_column(docs, text, lambda: lambda t: mask(t, find_spans(t)))


def _digest(text: str | None) -> tuple:
    spans = find_spans(text)
    said = [f"{k}:{s}:{e}" for k, s, e in spans]
    base = [x for x, y in zip(said, spans, strict=True) if y[0] in BASE]
    return (*[sum(y[0] == k for y in spans) for k in BASE], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans."""
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs, ["doc_id"], ["text"], lambda: lambda texts: map(_digest, texts), fields)
