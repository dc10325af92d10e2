"""WARC records: derivatives, links between records, files."""

import hashlib
import html as htmllib
import json
import time
import zlib
from html.parser import HTMLParser

from rivalry.llm import by_value, warc

by_value()
PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A &amp; B
 title</title><style>p{margin:0}</style><script>var t="</p><a href='/no'>";</script></head><body><!-- <a href="/hidden"> -->
<nav><a href="/one">One</a> <a href='two?x=1&amp;y=2'>Two</a></nav><p>First&nbsp;line<br>second &lt;b&gt;</p>
<p>4 < 5 <b>bold</b>text &eacute;&#233;</p></body></html>"""


def pages(spark, extra=()):
    return spark.createDataFrame([(1, "http://h.example/dir/p", PAGE), (2, None, None), (3, "http://x/", "just text"),
                                  (None, "http://y/\r\nX: injected", "<p>open <a href=z"), *extra],
                                 "page_id long, url string, html string")


def test_derivatives():
    rid, data = warc.response_record(1, "http://h.example/dir/p", PAGE)
    (mid, _, meta), (cid, _, conv) = warc.derivatives(data)
    head, block = warc.parse(meta)
    assert head["warc-refers-to"] == rid and head["warc-record-id"] == mid != cid and len(block) == int(head["content-length"])
    m = json.loads(block)
    assert m["title"] == "A & B title" and m["lang"] == "en" and m["status"] == "HTTP/1.1 200 OK"
    assert ["Content-Type", "text/html; charset=utf-8"] in m["headers"]
    assert [x["url"] for x in m["links"]] == ["http://h.example/one", "http://h.example/dir/two?x=1&y=2"]
    head, block = warc.parse(conv)
    assert head["warc-refers-to"] == rid and head["warc-target-uri"] == "http://h.example/dir/p"
    assert head["warc-block-digest"] == warc.digest(block)
    assert head["warc-source-payload-digest"] == warc.digest(PAGE.encode())
    assert block.decode().split("\n") == ["One Two", "First line", "second <b>", "4 < 5 boldtext éé"]
    assert warc.derivatives(warc.record([("WARC-Type", "warcinfo")], b"x")) == []


def test_digest_is_base32_sha1():
    import base64
    assert warc.digest(b"abc") == "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_summary(spark):
    got = warc.summary(warc.derive(warc.responses(pages(spark)))).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 8
    for p in (1, 2, 3, None):
        two = [r for r in got if r.page_id == p]
        assert {r.type for r in two} == {"metadata", "conversion"} and len({r.refers_to for r in two}) == 1
    assert next(r for r in got if r.page_id == 2 and r.type == "conversion").length == 0
    assert all("\n" not in r.target for r in got)
    assert next(r for r in got if r.page_id is None and r.type == "metadata").n_links == 1
    assert warc.summary(warc.derive(warc.responses(pages(spark).limit(0)))).count() == 0


def test_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "w")
    made = warc.responses(pages(spark)).unionByName(warc.derive(warc.responses(pages(spark)))).cache()
    files = warc.write_warc(made.repartition(2, "record_id"), folder).cache()
    assert sum(r.n for r in files.collect()) == 12
    back = warc.read_warc(files, folder)
    key = lambda d: sorted((r.record_id, r.type, zlib.crc32(r.record)) for r in d.collect())
    assert key(back) == key(made)
    # the derivatives of what was read are those of what was written
    assert key(warc.derive(back)) == key(made.where("type <> 'response'"))


def test_head_ends_without_its_tag():
    text = "All the text\nmore"
    body = "<p>All the text<p>more"
    head = '<html><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>x</script>'
    for page in (head + "<body>" + body, head + body, head + "</head>" + body, "<title>T</title>" + body,
                 "<!doctype html>\n" + head + "<!-- c -->\n<link rel=x href=/y>" + body, "<head>All the text" + body[15:],
                 "<head><title>a <!-- b</title></head>" + body, "<template>no</template>" + body, "<template>" + body):
        assert warc.plain_text(page) == text, page
    assert warc.plain_text("<p>junk<head><title>T</title>" + body) == "junk\n" + text
    assert warc.plain_text("<p>a</p><title>kept</title>") == "a\nkept"
    assert warc.plain_text("<p>a</p><noscript>kept</noscript><p>b</p><noscript>open <p>c") == "a\nkept\nb\nopen\nc"
    assert [x["url"] for x in warc.links("<template><a href=/x>", "http://h/")] == ["http://h/x"]


def test_encoded_bodies():
    import gzip
    page = PAGE.encode()
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    cut = lambda b: b"".join(b"%x;x=y\r\n%s\r\n" % (len(b[i:i + 100]), b[i:i + 100]) for i in range(0, len(b), 100)) + b"0\r\n\r\n"

    def read(body, *fields):
        head = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *fields]).encode()
        found = warc.derivatives(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"),
                                              ("WARC-Target-URI", "http://h.example/dir/p")], head + b"\r\n\r\n" + body))
        return json.loads(warc.parse(found[0][2])[1]), [warc.parse(r)[1] for _, kind, r in found if kind == "conversion"]
    meta, text = read(page)
    for body, *fields in ((cut(page), "Transfer-Encoding: chunked"), (gzip.compress(page), "Content-Encoding: gzip"),
                          (gzip.compress(page[:300]) + gzip.compress(page[300:]), "content-encoding: x-gzip"),
                          (zlib.compress(page), "Content-Encoding: deflate"), (raw, "Content-Encoding: deflate"),
                          (cut(gzip.compress(page)), "Transfer-Encoding: chunked", "Content-Encoding: GZIP"),
                          (cut(gzip.compress(page)), "Transfer-Encoding: gzip, chunked"),
                          (page, "Transfer-Encoding: chunked", "Content-Encoding: gzip"), (page, "Content-Encoding: identity")):
        m, t = read(body, *fields)
        assert (m["title"], m["links"], t) == (meta["title"], meta["links"], text), fields
    m, t = read(b"\x1b\x00", "Content-Encoding: br")
    assert m["undecoded"] == "br" and m["links"] == [] and m["title"] is None and t == []
    long = b"<p>" + b" ".join(b"%d" % (i * i) for i in range(20000))
    assert len(read(gzip.compress(long)[:-9000], "Content-Encoding: gzip")[1][0]) > 50000


class Plain(HTMLParser):
    """An independent reader: tags, text and links by the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.refs, self.text, self.hidden, self.title, self.lang = [], [], 0, None, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden += 1
            if tag == "title" and self.title is None:
                self.title = ""
        if tag == "html" and self.lang is None:
            self.lang = dict(attrs).get("lang")
        ref = next((v for k, v in attrs if k in ("href", "src")), None)
        if tag in ("a", "area", "link", "img", "iframe", "source") and ref is not None:
            self.refs.append((tag, ref))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.hidden -= 1

    def handle_data(self, text):
        if self.lasttag == "title" and self.hidden and not self.text:
            self.title += text
        if not self.hidden:
            self.text.append(text)


def test_given_pages_equal_an_independent_parser():
    import duckdb
    pages_ = duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE html IS NOT NULL").fetchall()
    assert len(pages_) > 100
    for (html,) in pages_:
        ours, theirs = warc.Page(html), Plain(html)
        assert "".join(ours.text.split()) == "".join("".join(theirs.text).split())
        assert [(t, htmllib.unescape(r).strip()) for t, r in ours.refs] == [(t, r.strip()) for t, r in theirs.refs]
        assert ours.lang == theirs.lang
        assert (ours.title is None) == (theirs.title is None)


def test_broken_pages_take_linear_time():
    for opener in ("<title>x", "<template>x", "<a ", "<noscript><title>a", "<!--", "<script>", "<a href=\"x", "<a href='x",
                   "<style>x", "<html lang", "</title", "<a src= href= ", "<", "</", "<!-- --"):
        page = opener * (1_000_000 // len(opener))
        began = time.thread_time()
        warc.links(warc.Page(page), "http://h/")
        assert time.thread_time() - began < 1.5, opener


def test_repeated_rows_other_columns_and_long_pages(spark):
    long = "<title>L</title>" + "<p>word <a href=/x>y</a>" * 40_000
    rows = [(1, "http://h/", long, "a", 9), (1, "http://h/", long, "a", 9), (2, "http://h/", PAGE, "b", 8)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, record string, type int")
    got = warc.summary(warc.derive(warc.responses(d))).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 4          # equal rows give equal records
    assert max(r.length for r in got) > 300_000
