"""WARC derivatives: response records become linked metadata and plain-text conversion records.

``respond`` writes a response record for a page, ``parse`` reads any record's bytes, ``derive`` makes the
two derivatives of a response.  Both refer to the response by WARC-Refers-To, keep its target, date and
identifier, and carry the digests of the response and their own.

Headers are lists of (name, value): a name may come again, and names are compared without regard to case.  Chunked and
gzip or deflate bodies (all members) are decoded before text is taken; the payload digest stays that of the bytes as sent.
The content type tells how a body is read: pages by one scanner that goes forward only, so unclosed tags and comments cost
no more than others; other text as it stands; anything else has no text.  The character set is that of a byte order mark,
of the header, of the page's ``meta``, else UTF-8.

Defined cases: null or empty html gives a response without payload and derivatives with empty text; a null
url is an empty target; bodies of other types, of encodings that are not known or damaged, and bodies that unpack to over
``LARGEST`` bytes have a metadata record that tells so and no conversion record; a body without a type is a page; damaged records give one row of type ``error``; repeated pages give equal records;
an empty table gives no rows; columns besides the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

from pyspark.sql import DataFrame

from ._common import LOWER_TABLE, map_rows

VERSION = "WARC/1.1"
#: The date of records whose page has none.
DATE = "1970-01-01T00:00:00Z"
#: Bytes that a body may unpack to.
LARGEST = 1 << 26
PAGES, PLAIN = ("text/html", "application/xhtml+xml", ""), ("text/", "application/json", "application/xml", "application/javascript")
_META = re.compile(rb"<meta[^>]{0,300}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Elements whose content is not text.
_SILENT = ("script", "style", "noscript", "template")
#: Elements that break lines.
_BREAKING = frozenset(
    "p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer title body head pre blockquote main aside br hr".split()
)
_LINKING = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r"\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A stable identifier of what ``parts`` name."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


Headers = list[tuple[str, str]]


def header(headers: Headers, name: str, default: str | None = None) -> str | None:
    """The first value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def build(kind: str, headers: Headers, block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def respond(url: str, body: str, key: object = None, date: str = DATE) -> bytes:
    """A response record with an HTTP message."""
    payload = body.encode()
    message = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        + payload
    )
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    return build(
        "response",
        [
            ("WARC-Record-ID", record_id("response", key, url)),
            ("WARC-Date", date),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(message)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        message,
    )


def _headers(data: bytes) -> tuple[str, Headers]:
    first, *rest = data.decode("utf-8", "replace").split("\r\n")
    out: Headers = []
    for line in rest:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def parse(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    first, headers = _headers(head)
    if not sep or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    size = header(headers, "Content-Length", "")
    if not size.isdecimal():
        raise ValueError("no content length")
    if len(rest) < int(size):
        raise ValueError("record is cut off")
    if not header(headers, "WARC-Type"):
        raise ValueError("no record type")
    return headers, rest[: int(size)]


def unchunk(body: bytes) -> bytes:
    """A chunked body as one piece; what follows a malformed size is left out."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            break
        if n <= 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def unpacked(data: bytes, bits: int, largest: int) -> bytes:
    """All members of a compressed body; zlib.error if the first is damaged, OverflowError past ``largest`` bytes."""
    out, size = [], 0
    while data:
        one = zlib.decompressobj(bits)
        try:
            while not one.eof and data:
                out.append(one.decompress(data, largest - size + 1))
                size += len(out[-1])
                if size > largest:
                    raise OverflowError
                data = one.unconsumed_tail
        except zlib.error:
            if size:
                break  # what follows the last whole member is no member
            raise
        data = one.unused_data if one.eof else b""
    return b"".join(out)


def decoded(payload: bytes, http: Headers, largest: int = LARGEST) -> tuple[bytes, str]:
    """The payload without transfer and content encodings, and what stands against it ('' if nothing does)."""
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower():
        payload = unchunk(payload)
    for coding in reversed((header(http, "Content-Encoding") or "").lower().split(",")):
        coding = coding.strip()
        if coding in ("", "identity"):
            continue
        kinds = {"gzip": (47,), "x-gzip": (47,), "deflate": (47, -15)}.get(coding)
        if not kinds:
            return payload, f"encoding {coding} is not known"
        for bits in kinds:
            try:
                payload = unpacked(payload, bits, largest)
                break
            except OverflowError:
                return b"", f"the body unpacks to over {largest} bytes"
            except zlib.error:
                continue
        else:
            return payload, f"the body is no {coding}"
    return payload, ""


def text_of_bytes(body: bytes, content_type: str, page: bool) -> str:
    """A body's characters."""
    told = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    meta = _META.search(body, 0, 2048) if page else None
    mark = next((name for sign, name in _MARKS if body.startswith(sign)), None)
    for name in (mark, told and told[1], meta and meta[1].decode("ascii", "replace")):
        try:
            if name:
                return body.decode(name, "replace")
        except LookupError:
            continue
    return body.decode("utf-8", "replace")


def read_page(source: str) -> tuple[str, str, str, list[dict[str, str]]]:
    """(text, title, language, links) of a page: hidden elements and tags go, block elements break lines, references are
    resolved.  One pass; a mark that is never closed is looked for once."""
    out: list[str] = []
    title: list[str] | None = None
    lang, links, at, n = "", [], 0, len(source)
    low = source.lower() if source.isascii() else source.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).decode("utf-8", "surrogatepass")
    never: set[str] = set()  # closing marks that do not come any more

    def find(mark: str, start: int) -> int:
        if mark in never:
            return -1
        got = low.find(mark, start)
        if got < 0:
            never.add(mark)
        return got

    def tag_end(start: int) -> int:
        """Place behind the '>' of a tag, quoted values passed over; the next '>' if a quote is not closed."""
        i = start
        while True:
            close = find(">", i)
            if close < 0:
                return -1
            q = min((x for x in (source.find('"', i, close), source.find("'", i, close)) if x >= 0), default=-1)
            if q < 0:
                return close + 1
            other = find(source[q], q + 1)
            if other < 0:
                return close + 1
            i = other + 1

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            out.append(source[at:])
            break
        out.append(source[at:lt])
        if low.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = lt + 4 if end < 0 else end + 3
            out.append(" ")
            continue
        m = _NAME.match(source, lt + 1)
        if not m and source[lt + 1 : lt + 2] not in ("!", "?"):
            out.append("<")
            at = lt + 1
            continue
        end = tag_end(m.end() if m else lt + 1)
        if end < 0:
            out.append(source[lt:])
            break
        name, closing = (m[1].lower(), source[lt + 1] == "/") if m else ("", False)
        at = end
        if not closing and name in _LINKING or name == "html":
            seen = set()
            for a in _ATTRIBUTE.finditer(source, m.end(), end - 1):
                key, value = a[1].lower(), next((v for v in a.groups()[1:] if v is not None), "")
                if key in seen:
                    continue
                seen.add(key)
                if name == "html" and key == "lang" and not lang:
                    lang = value.lower()
                elif key == _LINKING.get(name):
                    links.append({"path": f"{name.upper()}@/{key}", "url": html.unescape(value)})
        if name in _SILENT and not closing and source[end - 2] != "/":
            close = find(f"</{name}", end)
            if close >= 0:
                stop = find(">", close)
                at = n if stop < 0 else stop + 1
            out.append(" ")
        elif name in _BREAKING:
            if name == "title" and title is None and not closing:
                close = find("</title", end)
                title = [source[end : close if close >= 0 else n]]
            out.append("\n")
    return _tidy("".join(out)), _tidy(title[0]) if title else "", lang, links


def _tidy(t: str) -> str:
    t = _BLANKS.sub(" ", html.unescape(t) if "&" in t else t)
    return _LINES.sub("\n", t.replace(" \n", "\n")).strip()


def plain_text(source: str) -> str:
    return read_page(source)[0]


def derive(record: bytes) -> list[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the metadata and, where there is text, the conversion record of a response."""
    headers, block = parse(record)
    if header(headers, "WARC-Type").lower() != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, http = _headers(head)
    content_type = header(http, "Content-Type") or ""
    kind = content_type.split(";")[0].strip().lower()
    body, problem = decoded(payload, http)
    text, title, lang, links = "", "", "", []
    if not problem and kind in PAGES:
        text, title, lang, links = read_page(text_of_bytes(body, content_type, True))
    elif not problem and kind.startswith(PLAIN):
        text = text_of_bytes(body, content_type, False)
    elif not problem:
        problem = f"no text in {kind}"
    origin = header(headers, "WARC-Record-ID", "")
    about = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "Actual-Content-Type": header(headers, "Content-Type", ""),
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": http,
                    "Entity-Length": len(payload),
                    "Entity-Digest": digest(payload),
                    "HTML-Metadata": {"Title": title, "Language": lang, "Links": links, "Text-Length": len(text)},
                    **({"Conversion-Problem": problem} if problem else {}),
                },
            },
        }
    }
    out = []
    made = [("metadata", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "application/json")]
    if not problem:
        made.append(("conversion", text.encode("utf-8", "replace"), "text/plain"))
    for kind, data, content in made:
        out.append((
            kind,
            [
                ("WARC-Record-ID", record_id(kind, origin)),
                ("WARC-Refers-To", origin),
                ("WARC-Refers-To-Target-URI", header(headers, "WARC-Target-URI", "")),
                ("WARC-Refers-To-Date", header(headers, "WARC-Date", "")),
                ("WARC-Date", header(headers, "WARC-Date", DATE)),
                ("WARC-Target-URI", header(headers, "WARC-Target-URI", "")),
                ("WARC-Source-Payload-Digest", header(headers, "WARC-Payload-Digest") or digest(payload)),
                ("WARC-Block-Digest", digest(data)),
                ("Content-Type", content),
            ],
            data,
        ))
    return out


SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, "
    "source_block_digest string, source_headers string, block string, record_bytes long, record_digest string"
)


def derivatives(responses: DataFrame) -> DataFrame:
    """One row a derived record of ``responses`` (page_id, record binary)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def make():
        def run(cols):
            rows = []
            for i, r in zip(cols["page_id"], cols["record"], strict=True):
                try:
                    source = parse(bytes(r or b""))[0]
                    for kind, h, data in derive(bytes(r)):
                        whole, of = build(kind, h, data), dict(h)
                        rows.append((
                            i, kind, of["WARC-Record-ID"], of["WARC-Refers-To"], of["WARC-Target-URI"], of["WARC-Date"],
                            of["Content-Type"], len(data), of["WARC-Block-Digest"], of["WARC-Source-Payload-Digest"],
                            header(source, "WARC-Block-Digest"), json.dumps(source, ensure_ascii=False),
                            data.decode(), len(whole), digest(whole),
                        ))
                except ValueError as e:
                    rows.append((i, "error", *[None] * 10, str(e), None, None))
            return {k: [r[j] for r in rows] for j, k in enumerate(names)}

        return run

    return map_rows(responses.select("page_id", "record"), make, SCHEMA)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records (page_id, record) of a table of pages (page_id, url, html)."""

    def make():
        return lambda cols: {
            "page_id": cols["page_id"],
            "record": [
                respond(u or "", h or "", i)
                for i, u, h in zip(cols["page_id"], cols["url"], cols["html"], strict=True)
            ],
        }

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, record binary")
