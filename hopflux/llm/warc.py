"""WARC derivatives: every response record gets a linked metadata record and a plain-text conversion record.

Both new records refer to the response by its record id (WARC-Refers-To), keep its target, date and HTTP headers, and carry
the digest of the payload they were made from next to the digest of their own block.  A response's id is a name-based UUID of its
page id, url and payload digest, those of the others are made from it and the record type; so a rebuilt task writes the same records.
Pages are read once from left to right, in time linear in their length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.text import column_bytes

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:hopflux:warc")
#: Elements whose content is not text, and elements that end a line.
_DROPPED = frozenset({"script", "style", "template", "noscript"})
_BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav blockquote pre title head body html main aside td th".split())
_TAG = re.compile(r"(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I | re.A)
_PLAIN_TAG = re.compile(r"(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I | re.A)
_LETTER = re.compile(r"/?[a-z]", re.I | re.A)
_CLOSERS = {x: re.compile(rf"</{x}(?![^\s/>])[^>]*+(?:>|\Z)", re.I | re.A) for x in [*_DROPPED, "title"]}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_BLANK = re.compile(r"[^\S\n]++")
_LINES = re.compile(r" ?\n\s*+")  # after blanks have become single spaces


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def scan(page: str) -> tuple[str, str | None, list[str]]:
    """Visible text, title and link targets of a page, entities decoded; one line per block, no blank lines.

    Comments, scripts, styles and templates are no text; one that never ends reaches to the end of the page.  A ``<`` that begins no tag is
    text.  A tag may have ``>`` inside quotes, unless quotes on the page do not pair up.
    """
    out: list[str] = []
    title, links, at, tag = None, [], 0, _TAG
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("!", "?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        if not _LETTER.match(page, at):
            out.append("<")
            continue
        found = tag.match(page, at)
        if not found and tag is _TAG:
            tag = _PLAIN_TAG  # looked at once to the end of the page
            found = tag.match(page, at)
        if not found:  # no further tag ends
            at = start
            break
        slash, name, rest = found[1], found[2].lower(), found[3]
        at = found.end()
        if name in _BREAKS:
            out.append("\n")
        if slash:
            continue
        if name in _CLOSERS:
            close = _CLOSERS[name].search(page, at)
            inside = page[at : close.start() if close else len(page)]
            if name == "title":
                title = inside if title is None else title
                out += [inside, "\n"]
            else:
                out.append(" ")
            at = close.end() if close else len(page)
        elif name == "a":
            hrefs = [a or b or c for key, a, b, c in _ATTRIBUTE.findall(rest) if key.lower() == "href"]
            links += [html.unescape(hrefs[0])] if hrefs else []
    out.append(page[at:])
    text = _LINES.sub("\n", _BLANK.sub(" ", html.unescape("".join(out)))).strip()
    return text, None if title is None else _LINES.sub(" ", html.unescape(title).strip()), links


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length is added."""
    clean = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, gzip member or plain."""
    if record[:2] == b"\x1f\x8b":
        record = gzip.decompress(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def response(key: object, url: str, page: bytes, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of the response record of a page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}\r\n\r\n".encode() + page
    return [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(key, url, digest(page), "response")), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(page)), ("WARC-Block-Digest", digest(block)),
    ], block


def derive(headers: dict[str, str], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    page, source = payload.decode("utf-8", "replace"), headers["WARC-Record-ID"]
    text, title, links = scan(page)
    text = text.encode("utf-8", "replace")
    fields = [("source-" + k, v) for k, _, v in (line.partition(": ") for line in head.decode("latin-1").split("\r\n")[1:])]
    fields += [("source-payload-digest", headers["WARC-Payload-Digest"]), ("source-block-digest", headers["WARC-Block-Digest"]), ("text-block-digest", digest(text)), ("text-record", record_id(source, "conversion"))]
    fields += [("title", title)] if title is not None else []
    fields += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode("utf-8", "replace")

    def made(kind: str, content: str, body: bytes) -> tuple[list[tuple[str, str]], bytes]:
        return [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(source, kind)), ("WARC-Refers-To", source), ("WARC-Target-URI", headers["WARC-Target-URI"]),
            ("WARC-Date", headers["WARC-Date"]), ("Content-Type", content), ("WARC-Source-Payload-Digest", headers["WARC-Payload-Digest"]), ("WARC-Block-Digest", digest(body)),
        ], body

    return [made("metadata", "application/warc-fields", meta), made("conversion", "text/plain; charset=utf-8", text)]


_FIELDS = [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("record", pa.binary())]


def _build(date: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(low, 256), []
                for key, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2)), strict=True):
                    first = response(key, url or "", page or b"", date)
                    for headers, block in [first, *derive(dict(first[0]), first[1])]:
                        h, record = dict(headers), serialize(headers, block)
                        rows.append((key, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], h["Content-Type"], h.get("WARC-Source-Payload-Digest", h.get("WARC-Payload-Digest")), h["WARC-Block-Digest"], len(block), gzip.compress(record, 6, mtime=0) if compress else record))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return run


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", compress: bool = False) -> DataFrame:
    """Three rows per page, its response, metadata and conversion records, with the serialized record in ``record``.

    ``compress`` makes every record a gzip member of its own, so concatenated rows are a valid .warc.gz.  ``date`` stands
    for the fetch time, which the table does not have.

    Null url or html: the empty one.  Rows alike in id, url and html are one response and repeat its records, ids included; rows that differ in
    any of them have ids of their own.  A null id is written as None in the name that ids are made from.  An empty table gives an empty result.  Only the three named columns are read.  No shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, source_payload_digest string, block_digest string, content_length long, record binary"
    return rows.mapInArrow(_build(date, compress), kinds)
