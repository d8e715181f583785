"""News, instruments, reports and stores over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators, news, retrieval
from ..sources import feeds, readers
from . import market
from .registry import query, table

_ITEMS = """
ni AS (SELECT page_id AS item_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, html AS content, url,
  '2024-01-0' || (page_id % 9 + 1) AS publish_time, CASE page_id % 4 WHEN 0 THEN 'blue、ring' WHEN 1 THEN 'hot' WHEN 2 THEN 'x' ELSE 'Gear、small' END AS keyword FROM pages)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news items, with days and keywords dealt to them."""
    key = F.col("page_id")
    words = F.element_at(F.array(*(F.lit(w) for w in ("blue、ring", "hot", "x", "Gear、small"))), (key % 4 + 1).cast("int"))
    day = F.concat(F.lit("2024-01-0"), (key % 9 + 1).cast("string"))
    return table(spark, sf_dir, "pages").select(key.alias("item_id"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.col("html").alias("content"), "url", day.alias("publish_time"), words.alias("keyword"), F.lit(None).cast("string").alias("source"))


@query(
    f"""WITH {_ITEMS}, d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY url) AS k FROM ni WHERE publish_time = '2024-01-03')
SELECT title, md5(substr(coalesce(content, ''), 1, 300)) AS content_md5, 'unknown' AS source, url FROM d WHERE k = 1 OR title = ''"""
)
def date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a day, titles once; items without a title all stay.

    Of items that share title and url, which the SQL does not order, the one of the smallest id stands for them.
    """
    rows = news.date_events(_items(spark, sf_dir), "2024-01-03", most=None, order=[F.col("url"), F.col("item_id")])
    return rows.select("title", F.md5("content").alias("content_md5"), "source", "url")


@query(
    f"""WITH {_ITEMS}, w AS (SELECT item_id, unnest(string_split(lower(keyword), '、')) AS word FROM ni),
f AS (SELECT DISTINCT p_partkey AS query_id, item_id FROM part JOIN w ON contains(lower(p_name), word) WHERE length(word) >= 2)
SELECT query_id, item_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS place FROM f) WHERE place <= 10"""
)
def named_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News whose keywords stand in a query; the queries are the names of parts."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return news.named_items(asked, _items(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT keyword, count(*) AS n FROM ni GROUP BY keyword")
def news_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.keyword_counts(_items(spark, sf_dir))


@query("SELECT p_partkey AS code, p_name AS name FROM part WHERE contains(p_name, 'gear') ORDER BY p_partkey LIMIT 10")
def instrument_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    return indicators.find_instruments(rows, "gear", 10)


@query(
    """SELECT n_name, n_name || ' (all years): balance ' || printf('%.2f', b) || ' USD, customers ' || n::VARCHAR || '.' AS sentence
FROM (SELECT c_nationkey, round(sum(c_acctbal), 2) AS b, count(*)::BIGINT AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey"""
)
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each nation's customers."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("b"), F.count("*").alias("n"))
    rows = rows.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    # The number of customers has no unit and is written as it is.
    money = F.array(F.struct(F.lit("balance").alias("metric"), F.col("b").alias("value")))
    sentence = F.regexp_replace(news.narrative(F.col("n_name"), F.lit("all years"), money, {"balance": " USD"}), r"\.$", "")
    return rows.select("n_name", F.concat(sentence, F.lit(", customers "), F.col("n").cast("string"), F.lit(".")).alias("sentence"))


@query(
    f"""WITH {market._BARS},
g AS (SELECT symbol, date, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS c FROM bars),
a AS (SELECT symbol, date, count(*) OVER w AS n, avg(greatest(c, 0)) OVER w AS up, avg(greatest(-c, 0)) OVER w AS down FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
r AS (SELECT symbol, CASE WHEN n < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 'flat' WHEN round(100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-10 ELSE down END), 4) > 70 THEN 'overbought'
  WHEN round(100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-10 ELSE down END), 4) < 30 THEN 'oversold' ELSE 'neutral' END AS signal FROM a)
SELECT symbol, signal, count(*) AS n FROM r GROUP BY ALL"""
)
def rsi_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.signals(market.rsi(spark, sf_dir)).groupBy("symbol", "signal").agg(F.count("*").alias("n"))


@query(
    f"""WITH {market._BARS}, m AS (SELECT *, count(*) OVER w AS c, round(avg(close) OVER w, 4) AS ma, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)),
l AS (SELECT symbol, string_agg(date::VARCHAR || ' | ' || printf('%.2f', open) || ' | ' || printf('%.2f', close) || ' | ' || CASE WHEN c < 5 THEN '-' ELSE printf('%.2f', ma) END, chr(10) ORDER BY date) AS lines FROM m WHERE back <= 10 GROUP BY symbol),
s AS (SELECT symbol, max_by(close, date) AS latest, max(high) AS hi, min(low) AS lo, round((max_by(close, date) / min_by(close, date) - 1) * 100, 2) AS ch, sum((close > open)::BIGINT)::BIGINT AS up, sum((close <= open)::BIGINT)::BIGINT AS down
  FROM bars GROUP BY symbol HAVING count(*) >= 2)
SELECT symbol, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT symbol, '# ' || symbol || chr(10) || 'latest ' || printf('%.2f', latest) || ', high ' || printf('%.2f', hi) || ', low ' || printf('%.2f', lo) || ', change ' || printf('%.2f', ch) || '%, up ' || up || ', down ' || down || chr(10) || lines AS t FROM s JOIN l USING (symbol))"""
)
def bar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indicators.bar_report(market.bars(spark, sf_dir))
    return rows.select("symbol", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(
    """WITH p AS (SELECT text, CASE lang WHEN 'de' THEN 'foreign' WHEN 'fr' THEN 'foreign' WHEN 'en' THEN 'main' ELSE 'general' END AS pool FROM documents)
SELECT pool, count(*) AS n_docs, sum((length(coalesce(text, '')) = 0)::BIGINT)::BIGINT AS n_empty, round(avg(length(coalesce(text, ''))), 4) AS mean_chars FROM p GROUP BY pool"""
)
def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = {"de": "foreign", "fr": "foreign", "en": "main"}
    return retrieval.pool_statistics(table(spark, sf_dir, "documents").withColumn("pool", retrieval.pool_of(F.col("lang"), pools)))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|\d+(?:\.\d+)?%?')) AS term FROM documents)
SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM t"""
)
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.index_statistics(retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("SELECT 'documents' AS store, count(*) AS n_rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.store_counts({name: table(spark, sf_dir, name) for name in ("documents", "pages", "conversations")})


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 4"""
)
def latest_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four periods of each entity, here orders of customers."""
    from pyspark.sql import Window

    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(newest)).where("k <= 4")
    return rows.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_PLAIN = "trim(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288))"


@query(
    f"""WITH fi AS (SELECT page_id, (page_id // 50) % 4 AS kind, coalesce(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, coalesce(url, '') AS url, coalesce(html, '') AS html,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id::INT) AS ts FROM pages)
SELECT CASE kind WHEN 0 THEN '同花顺' WHEN 1 THEN '新浪财经' WHEN 2 THEN '东方财富' ELSE 'pages' END AS source, CASE kind WHEN 2 THEN {_PLAIN.format("title")} ELSE title END AS title,
  md5({_PLAIN.format("html")}) AS content_md5, strftime(CASE kind WHEN 1 THEN ts + INTERVAL 8 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS publish_time,
  CASE kind WHEN 0 THEN 'https://news.10jqka.com.cn/' || page_id || '.shtml' ELSE url END AS url FROM fi"""
)
def feed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the items of feed responses of four formats, fifty in each, read back as news."""
    key = F.col("page_id")
    at = F.expr("to_timestamp_ntz('2024-01-01 00:00:00') + make_dt_interval(0, cast(page_id as int), 0, 0)").cast("string")
    title = F.coalesce(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(key, title.alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), at.alias("at"))
    file = F.floor(key / 50).alias("file")
    seconds = (F.lit(1704067200) + key * 3600).cast("string")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.concat(F.substring("at", 9, 2), F.lit(" "), F.date_format(F.to_date(F.substring("at", 1, 10)), "MMM"), F.lit(" "), F.substring("at", 1, 4), F.substring("at", 11, 9), F.lit(" GMT"))
    xml = F.concat(F.lit("<item><title>"), safe(F.col("title")), F.lit("</title><description>"), safe(F.col("html")), F.lit("</description><link>"), safe(F.col("url")), F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    both = lambda **c: F.collect_list(F.struct(*(v.alias(k) for k, v in c.items())))
    wrap = lambda outer, inner, items: F.to_json(F.struct(F.struct(items.alias(inner)).alias(outer)))
    pushed = wrap("data", "list", both(id=key, title=F.col("title"), digest=F.col("html"), ctime=F.col("at")))
    rolled = wrap("result", "data", both(title=F.col("title"), intro=F.col("html"), ctime=seconds, url=F.col("url")))
    sought = F.concat(F.lit("jQuery("), wrap("result", "cmsArticleWebOld", both(title=F.col("title"), content=F.col("html"), date=F.col("at"), url=F.col("url"))), F.lit(")"))
    rss = F.concat(F.lit("<rss version=\"2.0\"><channel><title>pages</title>"), F.array_join(F.collect_list(xml), ""), F.lit("</channel></rss>"))
    out = None
    for kind, (feed, response) in enumerate(((feeds.PUSH, pushed), (feeds.ROLLING, rolled), (feeds.SEARCH, sought), (feeds.RssFeed(), rss))):
        responses = pages.where(F.floor(key / 50) % 4 == kind).groupBy(file).agg(response.alias("value"))
        part = feeds.news(responses, feed).select("source", "title", F.md5("content").alias("content_md5"), "publish_time", "url")
        out = part if out is None else out.unionByName(part)
    return out
