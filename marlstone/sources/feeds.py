"""Saved responses of news feeds as one table of news, batch or stream; the fetch is somebody else's.

A response is a file: JSON, JSON wrapped in a call, RSS or Atom. All of it is
column expressions over whole files, so a folder of responses is read alike by
``spark.read`` and ``spark.readStream``, whose checkpoint knows the files read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, extraction


@dataclass(frozen=True)
class JsonFeed:
    """Where a JSON feed keeps its items and their fields; of several fields the first that is filled counts.

    ``items`` is the dotted path of the list. ``wrapped`` responses stand in the
    brackets of a call. A ``unix`` time is in seconds and becomes a local time of
    ``zone``; other times stay as written. ``address`` makes a URL of the field.
    """

    source: str
    items: str
    content: tuple[str, ...]
    time: str
    url: str = "url"
    address: str = "%s"
    title: str = "title"
    marked_title: bool = False
    wrapped: bool = False
    unix: bool = False
    zone: str = "Asia/Shanghai"


@dataclass(frozen=True)
class RssFeed:
    """RSS 2.0, RSS 1.0 or Atom; the channel's title is the source unless one is given. Times become UTC."""

    source: str = ""


# Layouts of three JSON feeds.
PUSH = JsonFeed("同花顺", "data.list", ("digest", "title"), "ctime", "id", "https://news.10jqka.com.cn/%s.shtml")
ROLLING = JsonFeed("新浪财经", "result.data", ("intro", "summary"), "ctime", unix=True)
SEARCH = JsonFeed("东方财富", "result.cmsArticleWebOld", ("content", "title"), "date", marked_title=True, wrapped=True)
# Entities in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
# Zones that RFC 822 names.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_RSS_ITEM = "struct<title:string,description:string,link:string,pubDate:string,date:string>"
_XML = (
    f"channel struct<title:string,item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, title string, "
    f"entry array<struct<title:string,summary:string,content:string,link:{_LINK},published:string,updated:string>>, _corrupt_record string"
)
_KEPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def plain(text: Column) -> Column:
    """Text without tags, its entities replaced, stripped."""
    out = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return cleaning.strip(out)


def clock(seconds: Column, zone: str = "UTC") -> Column:
    """Unix seconds as ``yyyy-MM-dd HH:mm:ss`` of a zone, whatever the session's zone is."""
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("string")


def feed_time(written: Column) -> Column:
    """RFC 822 or ISO 8601 as UTC, ``yyyy-MM-dd HH:mm:ss``; null if it is neither."""
    zone = F.regexp_extract(written, r"([A-Za-z]+|[+-]\d{4})\s*$", 1)
    named = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    offset = F.coalesce(F.try_element_at(named, F.upper(zone)), zone)
    parts = [F.regexp_extract(written, r"^\s*(?:[A-Za-z]+,\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2})(:\d{2})?", i) for i in range(1, 6)]
    rfc = F.concat_ws(" ", parts[0], F.initcap(parts[1]), parts[2], F.concat(parts[3], F.when(parts[4] == "", ":00").otherwise(parts[4])), offset)
    at = F.when(parts[0] != "", F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")))
    # Without a zone an ISO time is taken as UTC, as feeds mean it.
    iso = F.when(written.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$"), F.trim(written)).otherwise(F.concat(F.trim(written), F.lit("Z")))
    return clock(F.unix_seconds(F.coalesce(at, F.when(written.rlike(r"^\s*\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(iso)))))


def _item_schema(feed: JsonFeed) -> tuple[str, str]:
    fields = dict.fromkeys([feed.title, *feed.content, feed.time, feed.url])
    item = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"
    whole = f"array<{item}>"
    first, *inner = feed.items.split(".")
    for name in reversed(inner):
        whole = f"struct<`{name}`:{whole}>"
    return item, f"`{first}` {whole}, _corrupt_record string"


def _told(rows: DataFrame, broken: Column, items: Column, item: str, most: int | None) -> DataFrame:
    """A row per item, and one without an item for a response that is broken or has no list."""
    error = F.when(broken, "bad response").when(items.isNull(), "no items")
    listed = items if most is None else F.slice(items, 1, most)
    nothing = F.array(F.lit(None).cast(item))
    return rows.withColumn("error", error).withColumn("x", F.explode(F.when(error.isNull(), listed).otherwise(nothing)))


def json_news(responses: DataFrame, feed: JsonFeed, most: int | None = None) -> DataFrame:
    """News of JSON responses (file, value), see ``news``."""
    item, schema = _item_schema(feed)
    # In brackets lies what stands between the first opening and the last closing one.
    body = F.when(F.col("value").rlike(r"(?s)\(.*\)"), F.regexp_extract("value", r"(?s)^[^(]*\((.*)\)", 1)).otherwise(F.col("value")) if feed.wrapped else F.col("value")
    rows = responses.withColumn("r", F.from_json(body, schema, _KEPT))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | (F.trim(F.coalesce(body, F.lit(""))) == "")
    rows = _told(rows, broken, F.col("r." + feed.items), item, most)
    field = lambda name: F.nullif(F.col("x").getField(name), F.lit(""))
    title = plain(field(feed.title)) if feed.marked_title else field(feed.title)
    time = clock(F.col("x").getField(feed.time).try_cast("bigint"), feed.zone) if feed.unix else field(feed.time)
    before, after = feed.address.split("%s")
    return _news(rows, F.lit(feed.source), title, F.coalesce(*(field(c) for c in feed.content)), time, F.concat(F.lit(before), F.coalesce(field(feed.url), F.lit("")), F.lit(after)))


def rss_news(responses: DataFrame, feed: RssFeed = RssFeed(), most: int | None = None) -> DataFrame:
    """News of RSS and Atom responses (file, value), see ``news``."""
    rows = responses.withColumn("r", F.from_xml("value", _XML, _KEPT | {"ignoreNamespace": "true"}))
    one = lambda *c: F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in c))
    made = lambda title, text, link, time: F.struct(title.alias("title"), text.alias("text"), link.alias("link"), time.alias("time"))
    of_item = lambda x: made(x["title"], x["description"], x["link"], one(x["pubDate"], x["date"]))
    link = lambda x: F.coalesce(F.filter(x["link"], lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")[0], x["link"][0])
    of_entry = lambda x: made(x["title"], one(x["summary"], x["content"]), one(link(x)["_href"], link(x)["_VALUE"]), one(x["published"], x["updated"]))
    items = F.coalesce(F.transform("r.channel.item", of_item), F.transform("r.item", of_item), F.transform("r.entry", of_entry))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | (F.trim(F.coalesce(F.col("value"), F.lit(""))) == "")
    rows = _told(rows, broken, items, "struct<title:string,text:string,link:string,time:string>", most)
    source = F.lit(feed.source) if feed.source else one(F.col("r.channel.title"), F.col("r.title"), F.lit("RSS"))
    return _news(rows, source, F.col("x.title"), F.col("x.text"), feed_time(F.col("x.time")), F.col("x.link"))


def _news(rows: DataFrame, source: Column, title: Column, content: Column, time: Column, url: Column) -> DataFrame:
    some = F.col("error").isNull()
    text = lambda c: F.when(some, F.coalesce(c, F.lit("")))
    out = {"source": source, "title": text(title), "content": text(plain(content)), "publish_time": F.when(some, time), "url": text(url)}
    made = rows.select("file", *(c.alias(n) for n, c in out.items()), "error")
    return made.withColumn("sentiment", F.when(F.col("error").isNull(), extraction.sentiment(F.col("title"))))


def news(responses: DataFrame, feed: JsonFeed | RssFeed, most: int | None = None) -> DataFrame:
    """(file, source, title, content, publish_time, url, error, sentiment): the items of responses (file, value).

    Missing texts are empty, a missing or unreadable time is null. A response that
    cannot be parsed, or has no list of items, is one row with its error and
    nothing else; one with an empty list gives no row. ``most`` cuts each response
    to its first items.
    """
    return rss_news(responses, feed, most) if isinstance(feed, RssFeed) else json_news(responses, feed, most)


def read_feed(spark: SparkSession, path: str, feed: JsonFeed | RssFeed, most: int | None = None, stream: bool = False, files_per_batch: int = 100) -> DataFrame:
    """The news of a folder of saved responses, one file each; as a stream each file once."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    raw = reader.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return news(raw.select(F.col("_metadata.file_name").alias("file"), "value"), feed, most)


def read_feeds(spark: SparkSession, folders: dict[str, JsonFeed | RssFeed], most: int | None = None, stream: bool = False) -> DataFrame:
    """Several folders, each with its feed, as one table of news."""
    out = None
    for path, feed in folders.items():
        part = read_feed(spark, path, feed, most, stream)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no feeds")
    return out
