"""WARC derivatives: metadata and plain-text records from response records.

:func:`responses` wraps fetched pages as WARC/1.1 response records (the HTTP
head and the html).  :func:`derive` reads response records, whoever wrote
them, and builds for each

* a ``metadata`` record: JSON with the title, the language, the source's HTTP
  headers and all links resolved against the target, and
* a ``conversion`` record: the page as plain text,

both with ``WARC-Refers-To`` the response, its target, its date and its
payload digest, and with digests of their own.  Record ids are name-based, so
a retried task writes the same records.  Records are rows (``record`` holds
the bytes of a whole record); :func:`write_warc` writes files, one gzip member
per record, and :func:`read_warc` reads any WARC file record by record.

Cases: a NULL html is an empty page, a NULL url the target ``about:blank``;
rows that agree in id, url and html give the same records; a record that is
not an HTTP response gives no derivative; broken markup and characters are
kept as text; chunked, gzip and deflate bodies are decoded first (what a broken
one gives up to the break; a body that is not in the encoding its head names is
taken as it stands), one in another encoding has no conversion and its metadata
names the encoding under ``undecoded``; a head without an end goes as far as its elements do; an empty table gives an empty result; other columns pass through
:func:`responses` only as far as they are named.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as htmllib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"       # of the pages, which carry none
SPACE_URL = uuid.uuid5(uuid.NAMESPACE_URL, "urn:rivalry:warc")

RECORDS = "page_id long, record_id string, type string, record binary"
SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("record", pa.binary())])

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9_]*)[^>]*(>?)|[!?/][^>]*(>?))")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "title", "template")}
_BREAK, _ONCE, _IN_HEAD, _LINK, _RAW, _HTML = 1, 2, 4, 8, 16, 32
#: What the reader does at an element: a line break (at its start tag only), an
#: element of the head, a link, one with raw text.
_KIND: dict[str, int] = {}
for _bit, _names in ((_BREAK, "br hr p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav main aside "
                              "blockquote pre dd dt dl form title"),
                     (_ONCE, "br hr"), (_IN_HEAD, "html head meta link base noscript"), (_LINK, "a area link img iframe source"),
                     (_RAW, "script style title template"), (_HTML, "html")):
    for _name in _names.split():
        _KIND[_name] = _KIND.get(_name, 0) | _bit
_REF = re.compile(r"\b(?:href|src)\s*=\s*", re.I)
_BARE = re.compile(r"[^\s>]+")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHUNK = re.compile(rb"(?:\r?\n)?([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_URL, json.dumps(parts, ensure_ascii=False))}>"


def one_line(value: str) -> str:
    """A header value: no line breaks can end the field."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {one_line(v)}".encode("utf-8", "surrogateescape") for k, v in headers),
             f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[:int(headers["content-length"])]


class Page:
    """What a page says, read in one pass from its first to its last character.

    ``text``: visible text, lines at block elements, white space collapsed;
    ``title``: of the first title element; ``lang``: of the html element;
    ``refs``: (tag, reference) of the links in order.

    Comments, scripts, styles, closed templates and titles in a head are not
    visible.  A head, tagged or not, ends before the first text or element
    that cannot stand in one; the text of a noscript stays.  A tag without
    its end is dropped to the end of the page; a title or template without
    one is broken markup and its text is kept.  No end is looked for twice
    where there is none, so the time is linear in the page.
    """

    def __init__(self, page: str):
        self.page, self.title, self.lang, self.refs = page, None, None, []
        out, at, n, head = [], 0, len(page), True
        none: set[str] = set()               # raw elements that do not close any more
        quotes = None
        search, put = _OPEN.search, out.append
        if page.startswith("\ufeff"):
            put("\ufeff")
            at = 1
        while at < n:
            m = search(page, at)
            to = m.start() if m else n
            if to > at:
                put(page[at:to])
                head = head and page[at:to].isspace()
            if not m:
                break
            slash, name, ended, closed = m.groups()
            at = m.end()
            if name is None:
                if closed is None:            # a comment
                    end = page.find("-->", at)
                    if end < 0:
                        break
                    put(" ")
                    at = end + 3
                elif not closed:              # no tag ends any more
                    break
                continue
            kind = _KIND.get(name)
            if kind is None:
                name = name.lower()
                kind = _KIND.get(name, 0)
            if not slash:
                if kind & _LINK:
                    if quotes is None:
                        quotes = {q: page.rfind(q) for q in "\"'"}
                    self._link(name, m.end(2), at - 1 if ended else at, quotes)
                if kind & _HTML and self.lang is None:
                    found = _LANG.search(page, m.end(2), at)
                    self.lang = found[1] if found else None
            if not ended:
                break
            if kind & _RAW and not slash:
                close = None if name in none else _CLOSE[name].search(page, at)
                if close is None:
                    none.add(name)
                    if name == "title" and self.title is None:
                        self.title = page[at:]
                    if name in ("script", "style"):
                        break
                    head = False
                elif name != "title" or head:
                    if name == "title" and self.title is None:
                        self.title = page[at:close.start()]
                    put(" ")
                    at = close.end()
                    continue
                elif self.title is None:      # a title in the body: its text is text
                    self.title = page[at:close.start()]
            elif not kind & _IN_HEAD:
                head = False
            elif name == "head":
                head = head or not slash
            if kind & _BREAK and not (slash and kind & _ONCE):
                put("\n")
        raw = htmllib.unescape("".join(out))
        lines = (_BLANKS.sub(" ", line).strip() for line in raw.split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def _link(self, name: str, start: int, end: int, quotes: dict[str, int]) -> None:
        """The first reference among the attributes of a tag; a quoted one may
        reach behind the tag's first >."""
        page = self.page
        for m in _REF.finditer(page, start, end):
            q = page[m.end():m.end() + 1]
            if q in quotes and quotes[q] > m.end():
                self.refs.append((name, page[m.end() + 1:page.index(q, m.end() + 1)]))
                return
            bare = _BARE.match(page, m.end(), end)
            if bare:
                self.refs.append((name, bare[0]))
                return


def plain_text(page: str) -> str:
    """Visible text of a page."""
    return Page(page).text


def links(page: str | Page, target: str) -> list[dict[str, str]]:
    """Its links, resolved against ``target``."""
    out = []
    for tag, raw in (page if isinstance(page, Page) else Page(page)).refs:
        ref = htmllib.unescape(raw).strip()
        try:
            out.append({"tag": tag, "url": urljoin(target, ref)})
        except ValueError:                 # a reference that is no address is kept as written
            out.append({"tag": tag, "url": ref})
    return out


def response_record(page_id: int | None, url: str | None, page: str | None) -> tuple[str, bytes]:
    """(id, record) of a fetched page."""
    target, body = url or "about:blank", (page or "").encode("utf-8", "surrogatepass")
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             + str(len(body)).encode() + b"\r\n\r\n" + body)
    payload = digest(body)
    rid = name_id("response", page_id, target, payload)
    return rid, record([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE),
                        ("WARC-Target-URI", target), ("WARC-Block-Digest", digest(block)),
                        ("WARC-Payload-Digest", payload), ("Content-Type", "application/http; msgtype=response")], block)


def unchunked(body: bytes) -> bytes:
    """A chunked body's bytes; a body that does not start with a chunk as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end():m.end() + size])
        at = m.end() + size
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """A gzip (any number of members) or deflate (with or without the zlib
    head) body's bytes; a body that is neither as it is."""
    for bits in (31,) if coding == "gzip" else (15, -15):
        out, rest = [], body
        while rest:
            d = zlib.decompressobj(bits)
            try:
                for i in range(0, len(rest), 1 << 12):      # in pieces: a break costs no more than its piece
                    out.append(d.decompress(rest[i:i + (1 << 12)]))
                    if d.eof:
                        break
            except zlib.error:
                break
            rest = d.unused_data + rest[i + (1 << 12):] if d.eof and coding == "gzip" else b""
        if any(out) or (not rest and body):
            return b"".join(out)
    return body


def decoded(body: bytes, http: list[list[str]]) -> tuple[bytes, str | None]:
    """The body without the encodings its HTTP head names, last one first, and
    the one that cannot be undone, if any."""
    for field in ("transfer-encoding", "content-encoding"):
        named = ",".join(v for k, v in http if k.lower() == field).lower().split(",")
        for coding in (c.strip().removeprefix("x-") for c in reversed(named)):
            if coding == "chunked":
                body = unchunked(body)
            elif coding in ("gzip", "deflate"):
                body = inflated(body, coding)
            elif coding not in ("", "identity"):
                return body, coding
    return body, None


def derivatives(data: bytes) -> list[tuple[str, str, bytes]]:
    """(id, type, record) of the metadata and the conversion of a response."""
    headers, block = parse(data)
    if headers.get("warc-type") != "response" or not block.startswith(b"HTTP/"):
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    http = [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    plain, undecoded = decoded(body, http)
    charset = re.search(r"charset=\"?([\w-]+)", kind, re.I)
    try:
        page = plain.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:                    # an unknown charset
        page = plain.decode("utf-8", "replace")
    page = "" if undecoded else page
    rid, target = headers["warc-record-id"], headers.get("warc-target-uri", "about:blank")
    seen = Page(page)
    meta = json.dumps({
        "target": target, "title": None if seen.title is None else " ".join(htmllib.unescape(seen.title).split()),
        "lang": seen.lang, "status": head.split(b"\r\n")[0].decode("latin-1"), "headers": http,
        "payload-digest": headers.get("warc-payload-digest", digest(body)), "links": links(seen, target),
        **({"undecoded": undecoded} if undecoded else {}),
    }, ensure_ascii=False).encode("utf-8", "surrogatepass")
    text = seen.text.encode("utf-8", "surrogatepass")
    out = []
    made = (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", text))
    for what, mime, content in made[:1] if undecoded else made:
        own = name_id(what, rid)
        out.append((own, what, record(
            [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", rid),
             ("WARC-Date", headers.get("warc-date", DATE)), ("WARC-Target-URI", target),
             ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest", digest(body))),
             ("WARC-Block-Digest", digest(content)), ("Content-Type", mime)], content)))
    return out


def _rows(rows) -> Iterator[pa.RecordBatch]:
    """Batches of at most about 16 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One response record per page."""
    def wrap(batches):
        yield from _rows((i.as_py(), rid, "response", data) for b in batches
                         for i, u, h in zip(b.column(0), b.column(1), b.column(2))
                         for rid, data in [response_record(i.as_py(), u.as_py(), h.as_py())])
    return pages.select(F.col(key).cast("long"), F.col(url), F.col(html)).mapInArrow(wrap, RECORDS)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records."""
    def build(batches):
        yield from _rows((i.as_py(), rid, kind, data) for b in batches for i, r in zip(b.column(0), b.column(1))
                         for rid, kind, data in derivatives(r.as_py()))
    return records.where("type = 'response'").select("page_id", "record").mapInArrow(build, RECORDS)


DIGEST = ("page_id long, type string, record_id string, refers_to string, target string, block_digest string, "
          "source_digest string, length long, n_links int, title string")


def summary(records: DataFrame) -> DataFrame:
    """One row per derivative record, read back from its bytes."""
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in (
        "type", "record_id", "refers_to", "target", "block_digest", "source_digest")), ("length", pa.int64()),
        ("n_links", pa.int32()), ("title", pa.string())])

    def read(batches):
        for b in batches:
            out = []
            for i, r in zip(b.column(0).to_pylist(), b.column(1)):
                h, block = parse(r.as_py())
                meta = json.loads(block) if h["warc-type"] == "metadata" else {}
                out.append((i, h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h["warc-target-uri"],
                            h["warc-block-digest"], h["warc-source-payload-digest"], len(block),
                            len(meta["links"]) if meta else None, meta.get("title")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return records.select("page_id", "record").mapInArrow(read, DIGEST)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the records as ``.warc.gz`` files, one per task; returns the
    files' names with their numbers of records (a task's retry writes a file
    of its own; the table names those that count - keep it)."""
    schema = pa.schema([("name", pa.string()), ("n", pa.int64())])

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for r in b.column(0):
                out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip.compress(r.as_py(), 6, mtime=0))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "n": n}], schema=schema)
    return records.select("record").mapInArrow(run, "name string, n long")


def stream_records(raw) -> Iterator[bytes]:
    """The records of an open, decompressed WARC file, one at a time."""
    while True:
        line = raw.readline()
        while line in (b"\r\n", b"\n"):
            line = raw.readline()
        if not line:
            return
        head = [line]
        while (line := raw.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        size = next(int(x.partition(b":")[2]) for x in head if x.lower().startswith(b"content-length:"))
        block = raw.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends early")
        yield b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """(name) -> the records of the files; ``page_id`` is NULL."""
    def run(batches):
        where, root = pafs.FileSystem.from_uri(folder)
        def all_():
            for b in batches:
                for name in b.column(0).to_pylist():
                    with where.open_input_file(f"{root}/{name}") as f:
                        raw = io.BufferedReader(gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f)
                        for data in stream_records(raw):
                            h, _ = parse(data)
                            yield None, h["warc-record-id"], h["warc-type"], data
        yield from _rows(all_())
    return files.select("name").mapInArrow(run, RECORDS)
