"""Links as pages write them, archives as others write them, and tables with clashing columns."""

import base64
import gzip
import hashlib
import io
import urllib.parse

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, url_filter, warc

BASE = "http://site.net/a/b/page?x=1"


@pytest.mark.parametrize("base", [BASE, "https://site.net", "http://site.net/", "http://site.net/a/b/"])
def test_targets_resolve_as_a_browser_does(spark, base):
    targets = ["http://o.com/p", "//o.com/p?q", "/de/1", "c", "../c", "../../../c", "./c/./d", "c/..", "?y=2", "/x/../y?z=/../", "HTTPS://o.com/", "../", "."]
    rows = spark.createDataFrame([(base, t) for t in targets], "b string, t string")
    got = {r.t: r.u for r in rows.select("t", url_filter.resolved(F.col("b"), F.col("t")).alias("u")).collect()}
    for t in targets:
        want = urllib.parse.urljoin(base, t)
        assert got[t].rstrip("/").lower() == want.rstrip("/").lower(), t
    none = spark.createDataFrame([(base, "mailto:x@y.z"), (base, "#top"), (base, ""), ("no scheme", "/a"), (None, "/a"), (base, None)], "b string, t string")
    assert none.select(url_filter.resolved(F.col("b"), F.col("t")).alias("u")).where("u is not null").count() == 0


def test_links_in_many_forms(spark):
    html = "".join(
        [
            '<link rel="stylesheet" href="/style.css">',
            '<LINK href=\'/de/1?a=1&amp;b=2\' REL=canonical>',
            '<link rel="shortcut canonical"\n href="//other.net/x">',
            '<meta http-equiv="refresh" content="0; url=next">',
            '<meta http-equiv="Refresh" content="5;URL=/second#part">',
            "<p>" * 5,
        ]
    )
    pages = spark.createDataFrame([(1, BASE, html, "s", True), (2, None, html, "s", True), (3, BASE, None, "s", False)], "page_id long, url string, html string, host string, hit boolean")
    got = {(r.a, r.b) for r in url_filter.page_links(pages).collect()}
    assert got == {(BASE, x) for x in ("http://site.net/de/1?a=1&b=2", "http://other.net/x", "http://site.net/a/b/next", "http://site.net/second")}


@pytest.mark.parametrize(
    "html,want",
    [
        ('<link title="a>b" rel="canonical" href="/de/1">', ["http://s.com/de/1"]),
        ('<link rel=canonical data-href="/wrong" href="/right">', ["http://s.com/right"]),
        ('<link rel="canonical" data-href="/wrong">', []),
        ('<link rel="canonical" href="&#x2F;de&#47;1&amp;lt;&#x1F600;&#0;">', ["http://s.com/de/1&lt;\U0001f600\ufffd"]),
        ('<base href="/deep/er/"><link rel="canonical" href="x">', ["http://s.com/deep/er/x"]),
        ('<link rel="canonical" href="x"><base target="_top"><base href="//t.net/y/"><base href="/no/">', ["http://t.net/y/x"]),
        ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/yes">', ["http://s.com/yes"]),
        ('<link rel="canonical" href="/yes"><!-- never closed <link rel="canonical" href="/no">', ["http://s.com/yes"]),
        ('<script>var x = \'<link rel="canonical" href="/no">\';</script>', []),
        ('<link rel="alternate" title="rel=canonical" href="/no">', []),
        ('<link rel="not-canonical" href="/no"><link rel="x  CANONICAL" href="/yes">', ["http://s.com/yes"]),
        ("<link href = '/yes' rel = 'canonical' href='/no'>", ["http://s.com/yes"]),
        ('<link rel="canonical" title="open href=/no>', []),
        ("<meta http-equiv=refresh content='0;url=\"/a b\"'>", ["http://s.com/a b"]),
        ('<meta http-equiv="refresh" content="3; /plain"><meta name="refresh" content="0;url=/no">', ["http://s.com/plain"]),
        ('<meta http-equiv="refresh" content="30">', []),
        ("<LINK REL=canonical HREF=/up/>", ["http://s.com/up/"]),
        ("<linked rel=canonical href=/no><link" + " x" * 20000 + " rel=canonical href=/far>", ["http://s.com/far"]),
    ],
)
def test_attributes_as_a_browser_reads_them(spark, html, want):
    pages = spark.createDataFrame([(1, "http://s.com/a/p", html)], "page_id long, url string, html string")
    assert sorted(r.b for r in url_filter.page_links(pages).collect()) == want


def test_very_long_pages(spark):
    html = "<p title='" + "x>" * 500_000 + "'>" + "<!-- " + "y" * 1_000_000 + " -->" + "<link rel=canonical href=/de/1>" + '<link title="' + "z" * 500_000
    pages = spark.createDataFrame([(1, "http://s.com/a", html)], "page_id long, url string, html string")
    assert [r.b for r in url_filter.page_links(pages).collect()] == ["http://s.com/de/1"]


def test_redirects_block_aliases(spark, sf):
    got = queries.url_alias_blocks(spark, sf)
    assert got.where("alias_blocked and rule is null and verdict = 'block'").count() > 0


def test_relative_canonical_links_spread_blocks(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://www.shop.com/old", link("/de/1"), "c"), (2, "http://mirror.net/x", link("//www.shop.com/old"), "c"), (3, "http://mirror.net/y", link("z"), "c"), (None, "http://mirror.net/x", None, "c"), (1, "http://www.shop.com/old", link("/de/1"), "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").withColumns({c: F.lit("c") for c in ("rule", "verdict", "alias", "node", "root", "a", "b")})
    got = sorted(((r.page_id, r.verdict) for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()), key=repr)
    assert got == sorted([(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (None, "block")], key=repr)


def foreign(payload, digest, block="", kind="response"):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\n"
    head += (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + (f"WARC-Block-Digest: {block(body)}\r\n" if block else "")
    return gzip.compress(head.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")


def test_digests_of_other_writers():
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    page = b"<html>other</html>"
    cases = [
        ("sha1:" + b32(page), True),
        ("SHA1:" + hashlib.sha1(page).hexdigest(), True),
        ("sha1:" + b32(b"no"), False),
        ("md5:" + hashlib.md5(page).hexdigest(), True),
        ("sha256:" + hashlib.sha256(page).hexdigest().upper(), True),
        ("sha256:" + base64.b32encode(hashlib.sha256(page).digest()).decode().rstrip("="), True),
        ("blake9:xx", None),
        ("sha1:not a digest", False),
        ("", None),
    ]
    for digest, good in cases:
        found = next(warc.iterate_records(io.BytesIO(foreign(page, digest))))
        assert found["digest_ok"] is good and found["payload_digest"] == hashlib.sha256(page).hexdigest()
    both = foreign(page, "sha1:" + b32(page), lambda body: "sha1:" + b32(body))
    assert next(warc.iterate_records(io.BytesIO(both)))["digest_ok"] is True
    wrong = foreign(page, "sha1:" + b32(page), lambda body: "sha1:" + b32(page))
    assert next(warc.iterate_records(io.BytesIO(wrong)))["digest_ok"] is False


def test_clashing_columns_and_foreign_ids(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, None, None)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("c") for c in ("payload", "digest", "owner", "revisit", "c", "path")})
    folder = warc.new_path(spark, "test-clash")
    got = warc.read_warc(warc.write_warc(pages, folder), folder, with_ids=True).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.record_id) for r in got] == [(1, "response", None, "<urn:page:1>"), (2, "revisit", 1, "<urn:page:2>"), (3, "response", None, "<urn:page:3>")]
