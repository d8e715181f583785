"""Four saved formats give one table of news, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import feeds

PUSHED = {"data": {"list": [{"id": 7, "title": "甲公司回购超预期", "digest": "<b>a</b> &lt;b&gt; &amp;amp; c ", "ctime": "2026-06-14 15:30:00"}, {"id": "8", "title": "t", "digest": ""}]}}
ROLLED = {"result": {"data": [{"title": "乙公司违规被处罚", "intro": "", "summary": "s", "ctime": "1705285800", "url": "u1"}, {"title": "x", "intro": "i", "ctime": "soon", "url": "u2"}]}}
SOUGHT = {"result": {"cmsArticleWebOld": [{"title": "<em>丙</em>(一)", "content": None, "date": "2024-01-15 10:30:00", "url": "u3"}]}}
RSS = """<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Wire</title><item>
<title>one &amp; two</title><description><![CDATA[<p>body</p>]]></description><link>l1</link><pubDate>Mon, 15 Jan 2024 10:30:00 +0800</pubDate></item>
<item><title>late</title><link>l2</link><pubDate>5 Jul 2024 09:05 EDT</pubDate></item><item><title>none</title><pubDate>soon</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atoms</title><entry><title>a</title><summary>s &lt;i&gt;t&lt;/i&gt;</summary>
<link rel="self" href="self"/><link rel="alternate" href="l3"/><updated>2024-02-01T00:30:00+01:00</updated></entry></feed>"""
FIELDS = ("source", "title", "content", "publish_time", "url", "sentiment", "error")

WANT = sorted(
    [
        ("同花顺", "甲公司回购超预期", "a <b> &amp; c", "2026-06-14 15:30:00", "https://news.10jqka.com.cn/7.shtml", "positive", ""),
        ("同花顺", "t", "t", "", "https://news.10jqka.com.cn/8.shtml", "neutral", ""),
        ("新浪财经", "乙公司违规被处罚", "s", "2024-01-15 10:30:00", "u1", "negative", ""),
        ("新浪财经", "x", "i", "", "u2", "neutral", ""),
        ("东方财富", "丙(一)", "丙(一)", "2024-01-15 10:30:00", "u3", "neutral", ""),
        ("Wire", "one & two", "body", "2024-01-15 02:30:00", "l1", "neutral", ""),
        ("Wire", "late", "", "2024-07-05 13:05:00", "l2", "neutral", ""),
        ("Wire", "none", "", "", "", "neutral", ""),
        ("Atoms", "a", "s t", "2024-01-31 23:30:00", "l3", "neutral", ""),
        ("同花顺", "", "", "", "", "", "bad response"),
        ("同花顺", "", "", "", "", "", "no items"),
        ("新浪财经", "", "", "", "", "", "bad response"),
        ("东方财富", "", "", "", "", "", "bad response"),
        ("RSS", "", "", "", "", "", "bad response"),
    ]
)


def told(rows):
    return sorted(tuple(r[f] or "" for f in FIELDS) for r in rows)


@pytest.fixture
def saved(tmp_path):
    folders = {}

    def save(kind, feed, *texts):
        (tmp_path / kind).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / kind / f"{i}.txt").write_text(text)
        folders[str(tmp_path / kind)] = feed

    save("push", feeds.PUSH, json.dumps(PUSHED, ensure_ascii=False), '{"data": {"li', '{"other": 1}', '{"data": {"list": []}}')
    save("roll", feeds.ROLLING, json.dumps(ROLLED), "<html>busy</html>")
    save("seek", feeds.SEARCH, "jQuery(" + json.dumps(SOUGHT) + ");", "jQuery(oops)")
    save("rss", feeds.RssFeed(), RSS, ATOM, "<rss><channel><item>")
    return folders


def test_formats_give_one_table(spark, saved):
    assert told(feeds.read_feeds(spark, saved).collect()) == WANT
    assert feeds.read_feeds(spark, saved, most=1).where("error is null").count() == 5


def test_times_do_not_depend_on_the_session(spark, saved):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert told(feeds.read_feeds(spark, saved).collect()) == WANT
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_reads_each_response_once(spark, saved, tmp_path):
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        rows = feeds.read_feeds(spark, saved, stream=True)
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert told(spark.read.parquet(str(tmp_path / "out")).collect()) == WANT


def test_no_feeds_and_no_files(spark, tmp_path):
    with pytest.raises(ValueError):
        feeds.read_feeds(spark, {})
    nothing = spark.createDataFrame([], "file string, value string")
    assert feeds.news(nothing, feeds.PUSH).count() == 0 and feeds.news(nothing, feeds.RssFeed()).count() == 0
    blank = spark.createDataFrame([("f", None), ("g", " ")], "file string, value string")
    for feed in (feeds.PUSH, feeds.SEARCH, feeds.RssFeed("s")):
        assert {r.error for r in feeds.news(blank, feed).select(F.col("error")).collect()} == {"bad response"}
