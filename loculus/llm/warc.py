"""WARC derivatives: metadata and plain-text conversion records linked to their response records.

Record tables have the columns record_id, warc_type, target_uri, warc_date, warc_headers (map) and block (binary).
``derive`` keeps the link (refers_to), the target, the date, the source's WARC and HTTP headers and digests. It reads each
record once, in Arrow batches; no record meets another. ``parse_warc`` and ``record_bytes`` read and write the file format.

Digests are ``sha256:`` and lower-case hex. Ids are ``urn:uuid`` made from the md5 of the source id, target and type, so a
repeated run gives the same ids.

The text of a response is its payload without chunks (``Transfer-Encoding: chunked``) and compression (``Content-Encoding:
gzip``, ``deflate`` or ``zstd``, also several, all members of a stream), decoded by the charset that its header, or else its first bytes, state; UTF-8 otherwise. HTML loses its
tags; all named and numeric character references are resolved; plain text stays; kinds that are no text give an empty body.

Defined results: only responses are derived from; a null block is empty; a block without a blank line has no HTTP headers
and is all payload; a null target stays null; header names are matched whatever their case; a payload digest that the source
states is kept, else it is computed over the payload as stored; a broken or cut-off chunk, stream or charset leaves the bytes
as they are, and bytes that are no text, lone surrogates too, become U+FFFD; a coding that can't be undone here (br) gives an
empty text beside the full metadata; repeated records give repeated derivatives; a null record id gives derivatives
that refer to nothing; texts of any length are read whole in linear time; an empty table gives an empty one; columns of other
names are ignored, clashing ones too.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "record_id string, warc_type string, target_uri string, warc_date string, warc_headers map<string,string>, block binary"
DERIVED = (
    "source_id string, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
    "block_digest string, payload_digest string, source_headers map<string,string>, http_headers string, body string"
)
#: Elements whose content is no text; elements that end a line.
DROPPED = ("script", "style", "noscript", "template", "svg", "head")
BREAKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|blockquote|pre|hr|form|title|dd|dt|dl"
BATCH_BYTES = 16_000_000

_OPEN = {t: re.compile(rf"<{t}[\s>]", re.I | re.A) for t in DROPPED}
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I | re.A) for t in DROPPED}
_BREAK = re.compile(rf"</?(?:{BREAKS})(?:[\s/][^>]*)?>", re.I | re.A)
_TAG = re.compile(r"<[^>]*>")
_BLANKS = re.compile(r"[ \t\r\f]+")
_LINES = re.compile(r" ?\n[ \n]*")
_STATUS = re.compile(r"HTTP/[0-9.]+ ([0-9]{3})")
_KIND = re.compile(r"\ncontent-type: *([^\r\n;]*)", re.I)
_META = re.compile(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", re.I)


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest_of(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def _uuid(*parts: str) -> str:
    h = hashlib.md5("|".join(parts).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _without(t: str, start, end, by: str) -> str:
    """The text without what lies from each start to the next end; stops at a start without an end, so it is linear."""
    out, at = [], 0
    while (a := start(t, at)) and (b := end(t, a[1])):
        out += [t[at : a[0]], by]
        at = b[1]
    return "".join(out) + t[at:] if out else t


def _finder(word: str):
    def find(t: str, at: int) -> tuple[int, int] | None:
        i = t.find(word, at)
        return None if i < 0 else (i, i + len(word))

    return find


def _searcher(pattern: re.Pattern):
    def search(t: str, at: int) -> tuple[int, int] | None:
        m = pattern.search(t, at)
        return m.span() if m else None

    return search


def html_text(t: str) -> str:
    """Plain text of HTML: a line for each block, runs of blanks as one."""
    t = _without(t, _finder("<!--"), _finder("-->"), "")
    for tag in DROPPED:
        t = _without(t, _searcher(_OPEN[tag]), _searcher(_CLOSE[tag]), " ")
    last = t.rfind(">") + 1  # no tag begins behind it, and every "<" before it ends
    t = _TAG.sub("", _BREAK.sub("\n", t[:last])) + t[last:]
    return plain_text(html.unescape(t).replace("\xa0", " ") if "&" in t else t.replace("\xa0", " "))


def plain_text(t: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", t)).strip(" \n")


def fields_of(head: str) -> dict[str, str]:
    """HTTP header fields by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for line in head.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def dechunked(data: bytes) -> bytes:
    """The payload of chunks; as it is if they are broken."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return data
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            return data
        at = end + 2 + n + 2
    return data


def _inflated(data: bytes, bits: int) -> bytes:
    """All members of a stream one after the other; an error if one of them is broken or does not end."""
    out = []
    while data:
        d = zlib.decompressobj(bits)
        out.append(d.decompress(data))
        if not d.eof:
            raise zlib.error("the stream does not end")
        data = d.unused_data if bits == 31 else b""
        if data and not data.strip(b"\0"):  # padding behind the last member
            break
    return b"".join(out)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    out, d = [], None
    while data:
        d = zstandard.ZstdDecompressor().decompressobj()
        out.append(d.decompress(data))
        if not d.eof:
            raise zlib.error("the frame does not end")
        data = d.unused_data
    return b"".join(out)


def decompressed(data: bytes, coding: str) -> bytes | None:
    """Without the codings of a Content-Encoding header, the last first; as it is if a stream is broken, cut off or was unpacked
    before. None if a coding is not known here (br), so that its bytes are not taken for text."""
    whole = data
    for name in reversed([c.strip() for c in coding.split(",")]):
        if name in ("", "identity", "utf-8"):
            continue
        ways = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ())
        if not ways and name != "zstd":
            return None
        for bits in ways or (0,):
            try:
                data = _inflated(data, bits) if ways else _unzstd(data)
                break
            except Exception as e:
                if not isinstance(e, zlib.error) and "zstd" not in type(e).__module__.lower() and type(e).__name__ != "ZstdError":
                    raise
        else:
            return whole
    return data


def whole_characters(t: str) -> str:
    """Surrogate pairs as the character that they stand for, lone surrogates as U+FFFD, so that the text can be written."""
    return t if t.isascii() else t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def text_of(payload: bytes, head: str) -> str:
    """The plain text of a response's payload."""
    f = fields_of(head)
    kind, _, rest = f.get("content-type", "").lower().partition(";")
    kind = kind.strip()
    if kind and not kind.startswith("text/") and not any(x in kind for x in ("html", "xml", "json")):
        return ""
    if "chunked" in f.get("transfer-encoding", "").lower():
        payload = dechunked(payload)
    payload = decompressed(payload, f.get("content-encoding", "").strip().lower())
    if payload is None:
        return ""
    stated = re.search(r"charset=[\"']?([\w.:-]+)", rest)
    meta = None if stated else _META.search(payload[:2048])
    name = stated.group(1) if stated else meta.group(1).decode("ascii", "replace") if meta else "utf-8"
    try:
        t = payload.decode(name, "replace")
    except (LookupError, UnicodeError):
        t = payload.decode("utf-8", "replace")
    t = whole_characters(t)
    return whole_characters(plain_text(t) if kind == "text/plain" else html_text(t))


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records, with the columns of DERIVED."""
    r = records.where(F.col("warc_type") == "response").select(
        "record_id", "target_uri", "warc_date", F.coalesce("warc_headers", F.create_map().cast("map<string,string>")).alias("warc_headers"), F.coalesce("block", F.lit(b"")).alias("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [(n, pa.string()) for n in ("source_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type")]
            + [("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("source_headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.string()), ("body", pa.string())]
        )

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for b in batches:
            rows: list[tuple] = []
            held = 0
            blocks = b.column("block")
            for i, (rid, uri, date, heads) in enumerate(zip(*(b.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "warc_headers")), strict=True)):
                block = blocks[i].as_py()
                cut = block.find(b"\r\n\r\n")
                head, payload = (block[:cut].decode("utf-8", "replace"), block[cut + 4 :]) if cut >= 0 else ("", block)
                stated = next((v for k, v in heads if k.lower() == "warc-payload-digest" and v), None) or _digest(payload)
                status, kind = _STATUS.match(head), _KIND.search(head)
                meta = "".join(
                    f"{k}: {v}\r\n"
                    for k, v in (
                        ("http-status", status.group(1) if status else ""), ("http-content-type", kind.group(1) if kind else ""), ("source-block-digest", _digest(block)),
                        ("source-payload-digest", stated), ("source-payload-length", len(payload)),
                    )
                )
                for kind_, media, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain", text_of(payload, head))):
                    raw = body.encode("utf-8")
                    rows.append((rid, kind_, _uuid(rid or "", uri or "", kind_), rid, uri, date, media, len(raw), _digest(raw), stated, heads, head, body))
                    held += len(raw) + 500
                if held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return r.mapInArrow(run, DERIVED)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records; the page id stays beside them."""
    html_ = F.coalesce("html", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html_).cast("string"), F.lit("\r\n\r\n"), html_)
    rid = uuid_of(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.lit("response"), digest_of(html_))
    heads = F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), rid, F.lit("WARC-Payload-Digest"), digest_of(html_))
    return pages.select("page_id", rid.alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), heads.alias("warc_headers"), block.cast("binary").alias("block"))


def records_in(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped (one member a record or all in one), unpacked as they are read."""
    raw = io.BytesIO(data)
    f = gzip.open(raw) if data[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        heads: dict[str, str] = {}
        name = ""
        while (h := f.readline()) not in (b"", b"\r\n", b"\n"):
            s = h.decode("utf-8", "replace").rstrip("\r\n")
            if s[:1] in " \t" and name:
                heads[name] += " " + s.strip()
            else:
                name, _, v = s.partition(":")
                heads[name] = v.strip()
        low = {k.lower(): v for k, v in heads.items()}
        size = low.get("content-length", "0")
        block = f.read(int(size) if size.isdigit() else 0)
        yield {"record_id": low.get("warc-record-id"), "warc_type": low.get("warc-type"), "target_uri": low.get("warc-target-uri"), "warc_date": low.get("warc-date"), "warc_headers": heads, "block": block}


def parse_warc(files: DataFrame, content: str = "content") -> DataFrame:
    """Records of files read with Spark's binaryFile source, so from any store that Spark reads.

    That source holds a file, compressed as it is, in one row (2 GB at most); its records are unpacked one at a time and passed
    on in batches of bounded bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b[content]:
                held: list[dict] = []
                size = 0
                for r in records_in(b"" if data is None else bytes(data)):
                    held.append(r)
                    size += len(r["block"]) + 500
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(held)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held)

    return files.select(content).mapInPandas(run, RECORD)


def record_bytes(derived: DataFrame) -> DataFrame:
    """Each derived record in the file format: record_id, record (binary); concatenated they are a WARC file."""
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.col("warc_type")), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")), F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")), F.concat(F.lit("WARC-Date: "), F.col("warc_date")), F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("payload_digest")), F.concat(F.lit("Content-Type: "), F.col("content_type")), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return derived.select("record_id", F.concat(head, F.lit("\r\n\r\n"), F.col("body"), F.lit("\r\n\r\n")).cast("binary").alias("record"))
