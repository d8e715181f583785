"""Knowledge-base queries over documents: identities, changes, removal, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import grade
from ..operators import knowledge
from .registry import query, table


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", "text", knowledge.doc_key(F.col("source"), F.col("text")).alias("key"), knowledge.content_hash(F.col("text")).alias("digest"))


_KEYED = """
keyed AS (SELECT doc_id, source, lang, text, substr(sha256(coalesce(source, '') || '|' || substr(coalesce(text, ''), 1, 200)), 1, 16) AS key,
  substr(sha256(coalesce(text, '')), 1, 16) AS digest FROM documents)
"""


@query(f"WITH {_KEYED} SELECT doc_id, key, digest FROM keyed")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("doc_id", "key", "digest")


@query(
    f"""WITH {_KEYED}, n AS (SELECT * FROM keyed WHERE lang <> 'en' AND key NOT IN (SELECT key FROM keyed WHERE lang = 'en'))
SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM n) WHERE k = 1"""
)
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of other languages that the English knowledge base does not have, first of equals."""
    rows = _keyed(spark, sf_dir)
    new = knowledge.new_documents(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), "key", [F.col("doc_id")])
    return new.select("doc_id", "key")


@query(
    f"""WITH {_KEYED}, one AS (SELECT key, min(digest) AS digest FROM keyed GROUP BY key), o AS (SELECT * FROM one WHERE substr(key, 1, 1) <> 'a'),
n AS (SELECT key, CASE WHEN substr(key, 1, 1) = 'c' THEN digest || 'x' ELSE digest END AS digest FROM one WHERE substr(key, 1, 1) <> 'b')
SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.digest <> n.digest THEN 'edited' ELSE 'unchanged' END AS change, count(*) AS n
FROM o FULL JOIN n ON o.key = n.key GROUP BY 1"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions that differ by added, removed and edited documents."""
    one = _keyed(spark, sf_dir).groupBy("key").agg(F.min("digest").alias("digest"))
    head = F.substring("key", 1, 1)
    new = one.where(head != "b").withColumn("digest", F.when(head == "c", F.concat("digest", F.lit("x"))).otherwise(F.col("digest")))
    return knowledge.difference(one.where(head != "a"), new).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE source <> 'src1' AND NOT contains(lower(text), 'license') GROUP BY lang")
def remove_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = knowledge.remove(table(spark, sf_dir, "documents"), keyword="license", sources=["src1"])
    return left.groupBy("lang").agg(F.count("*").alias("n"))


@query(
    """SELECT source, count(*) AS n, floor(avg(length(text)))::BIGINT AS mean_chars, min(length(text)) AS least, max(length(text)) AS most,
round(stddev_pop(length(text)) / avg(length(text)), 4) AS variation FROM documents GROUP BY source"""
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.floor(F.avg(n)).alias("mean_chars"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.stddev_pop(n) / F.avg(n), 4).alias("variation"))


@query(
    """SELECT field, present, round(present / n, 4) AS share FROM (
SELECT count(*) AS n, unnest(['text', 'lang', 'source', 'n_chars']) AS field,
 unnest([count(nullif(text, '')), count(nullif(lang, '')), count(nullif(source, '')), count(n_chars)]) AS present FROM documents)"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.field_coverage(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query(
    """WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id) AS k FROM t WHERE title <> '') WHERE k = 1"""
)
def title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items deduplicated by title, the first wins; items without a title are none."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return knowledge.titled(rows, "title", [F.col("page_id")]).select("page_id", "url")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def archive_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 rows of an append-only log."""
    return knowledge.newest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 500, [F.desc("ts"), F.desc("event_id")])


@query(
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, round(avg(value), 4) AS mean,
CASE WHEN avg(value) / 100 >= 0.9 THEN 'A' WHEN avg(value) / 100 >= 0.75 THEN 'B' WHEN avg(value) / 100 >= 0.6 THEN 'C' WHEN avg(value) / 100 >= 0.4 THEN 'D' ELSE 'F' END AS grade
FROM events GROUP BY event_type"""
)
def usage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a log by type, with a grade; no mutable counters are kept."""
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    out = rows.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.avg("value").alias("m"))
    return out.select("event_type", "n", "users", "total", F.round("m", 4).alias("mean"), grade(F.col("m") / 100).alias("grade"))


@query(
    """SELECT n_name, metric, round(value, 2) AS value, round(other, 2) AS other, round(value - other, 2) AS difference FROM (
SELECT n_name, unnest(['balance', 'customers']) AS metric, unnest([sum(c_acctbal), count(*)::DOUBLE]) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
JOIN (SELECT unnest(['balance', 'customers']) AS metric, unnest([sum(c_acctbal), count(*)::DOUBLE]) AS other FROM customer WHERE c_nationkey = 0) USING (metric)"""
)
def compare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each nation beside those of the first one."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("b"), F.count("*").cast("double").alias("n"))
    long = rows.selectExpr("c_nationkey", "stack(2, 'balance', b, 'customers', n) AS (metric, value)")
    first = long.where("c_nationkey = 0").select("metric", F.col("value").alias("other"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = long.join(names, "c_nationkey").join(first, "metric")
    return out.select("n_name", "metric", F.round("value", 2).alias("value"), F.round("other", 2).alias("other"), F.round(F.col("value") - F.col("other"), 2).alias("difference"))
