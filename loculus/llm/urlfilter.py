"""URL rules by a bit-parallel wildcard automaton.

Every glob becomes a run of positions in one multiword bit mask. For a canonical URL all globs are simulated at once:

    state = (((state << 1) | starts) & takes[c]) | (state & loops[c])

with one mask a byte for the positions that take it and one for the positions that stay on it (a wildcard). Many URLs
are stepped together, a row of words each, so a step over a column of bytes is a handful of array operations.

Globs are matched against ``.host`` + path as a whole: ``*`` stands for any run without a slash, ``**`` for any run,
``?`` for one byte other than a slash. A rule (host, path) is the glob ``*.host`` + path + ``**`` over the url as it is
written. Blocked globs see the canonical url, see ``canonical``, so no spelling of a place gets past them; they do not tell
A-Z from a-z.

Defined results: a null url, or one without ``://``, has an empty host and path, matches no glob and gets the default
verdict; bytes above 127 are ordinary; urls are never cut. Repeated rows, ids and nulls in the id come out as they came in, one
row each. Of rules that are equally long the first one listed decides, of globs the first that matches. An empty table gives no
rows. Other columns of the table are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, map_rows


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class GlobAutomaton:
    """Multiword Shift-And over bytes for a list of globs."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        total = sum(len([t for t in ts if t not in ("*", "**")]) + 1 for ts in tokens)
        self.words = max(1, (total + 63) // 64)
        takes, loops = np.zeros((256, total), bool), np.zeros((256, total), bool)
        first, self.finals = np.zeros(total, bool), []
        slash = ord("/")
        any_byte = np.arange(256)
        at = 0
        for ts in tokens:
            first[at] = True  # the position before any byte: always on at the start, kept only by its loops
            for t in ts:
                if t in ("*", "**"):
                    loops[any_byte if t == "**" else any_byte[any_byte != slash], at] = True
                else:
                    at += 1
                    takes[any_byte[any_byte != slash] if t == "?" else t, at] = True
            self.finals.append(at)
            at += 1
        self.takes, self.loops = self._pack(takes), self._pack(loops)
        self.first = self._pack(first[None])[0]

    @staticmethod
    def _tokens(glob: str) -> list:
        out: list = []
        raw = glob.encode()
        i = 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                out.append("**")
                i += 2
            else:
                out.append("*" if raw[i : i + 1] == b"*" else "?" if raw[i : i + 1] == b"?" else raw[i])
                i += 1
        return out

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Which globs match each whole url: an array urls x globs of bool."""
        out = np.zeros((len(urls), len(self.finals)), bool)
        if not urls:
            return out
        lens = np.array([len(u) for u in urls])
        order = np.argsort(-lens, kind="stable")
        at = 0
        while at < len(urls):  # rows of similar length together, bounded bytes at once
            n = max(1, min(len(urls) - at, 8_000_000 // max(1, int(lens[order[at]]))))
            part = order[at : at + n]
            out[part] = self._step([urls[i] for i in part], lens[part])
            at += n
        return out

    def _step(self, urls: list[bytes], lens: np.ndarray) -> np.ndarray:
        width = int(lens[0])
        raw = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in urls), np.uint8).reshape(len(urls), width)
        state = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        left = len(urls)
        for k in range(width):
            while left and lens[left - 1] <= k:
                left -= 1
            s, c = state[:left], raw[:left, k]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:left] = (moved & self.takes[c]) | (s & self.loops[c])
        f = np.array(self.finals)
        return (state[:, f // 64] >> (f % 64).astype(np.uint64) & one).astype(bool)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    before, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = len(rest)
    for c in "?#":
        p = rest.find(c)
        end = p if 0 <= p < end else end
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return _lower(host), path


#: Characters that mean the same with and without percent-encoding (RFC 3986), and the ports that a scheme implies: fixed values.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
PORTS = {"http": "80", "https": "443"}
_ESCAPE = re.compile("%[0-9A-Fa-f]{2}")


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass")


def _unescaped(text: str) -> str:
    """Escapes of unreserved characters undone, in one pass; the others stay."""

    def plain(m: re.Match) -> str:
        c = chr(int(m.group()[1:], 16))
        return c if c in UNRESERVED else m.group()

    return _ESCAPE.sub(plain, text) if "%" in text else text


def canonical(url: str | None, host: str, path: str) -> str:
    """One spelling of a place, for globs: ``.host`` + path of a url, in lower case (A-Z); empty if host and path are.

    Escapes of unreserved characters are undone. The host loses user names, the port that its scheme implies, an empty port and
    a last dot. Of the path doubled slashes become one and dot segments are resolved; an empty path is ``/``.
    """
    if not host and not path:
        return ""
    host, path = _lower(_unescaped(host)), _lower(_unescaped(path))
    host = host.rpartition("@")[2]
    name, colon, port = host.rpartition(":")
    if colon and port in ("", PORTS.get(_lower((url or "").partition("://")[0]))):
        host = name
    host = host.removesuffix(".")
    if "//" in path or "/." in path:
        kept: list[str] = []
        for part in path.split("/"):
            if part == "..":
                del kept[-1:]
            elif part not in ("", "."):
                kept.append(part)
        ends = "/" if kept and path.endswith(("/", "/.", "/..")) else ""
        path = "/" + "/".join(kept) + ends
    return f".{host}{path or '/'}"


def judge(pages: DataFrame, rules: list[Rule], blocked: list[str], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict, pattern.

    The longest fitting rule decides; without one, a glob of ``blocked`` that matches the canonical url blocks (``pattern``
    names the first); else the default verdict holds. Host and path are those of the url as written.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [r.glob for r in ranked] + [_lower(g) for g in blocked]

    def make():
        automaton = GlobAutomaton(globs)

        def rows(urls):
            parts = [split_url(u) for u in urls]
            written = [f".{h}{p}" if h or p else "" for h, p in parts]
            hit = automaton.match([w.encode("utf-8", "surrogatepass") for w in written])
            forms = [canonical(u, h, p) for u, (h, p) in zip(urls, parts, strict=True)]
            other = [i for i, (f, w) in enumerate(zip(forms, written, strict=True)) if f != w]
            again = automaton.match([forms[i].encode("utf-8", "surrogatepass") for i in other])
            hit[other, len(ranked) :] = again[:, len(ranked) :]
            for (h, p), rh, gh in zip(parts, hit[:, : len(ranked)], hit[:, len(ranked) :], strict=True):
                r = ranked[int(rh.argmax())] if rh.any() else None
                g = blocked[int(gh.argmax())] if gh.any() else None
                yield h, p, r and r.name, r.verdict if r else "block" if g else default, g

        return rows

    return map_rows(pages, [key], [url], make, "host string, path string, rule string, verdict string, pattern string")
