"""The registered query of each operator, over its whole table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, line_dedup, phrase_queries, quality, sharding, simhash, substring_dedup, url_filter, warc

#: (verdict, host, path prefix)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
REPEAT_WORDS = 35
SIMHASH_BITS = 4
SIMHASH_SHINGLE = 4
#: Added to the labelled share of good documents, so that sampling noise costs few of them.
QUALITY_MARGIN = 0.005
#: The ratio of the models is tempered to so many n-grams; None would give the plain ratio.
QUALITY_REFERENCE = 20
SHARD_BYTES = 64 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, _table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), margin=QUALITY_MARGIN, reference=QUALITY_REFERENCE)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), REPEAT_WORDS)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), SIMHASH_BITS, SIMHASH_SHINGLE)


def encoded(docs: DataFrame, with_ids: bool = False, verify: bool = False) -> DataFrame:
    """Encode documents by the byte-level vocabulary and decode them again."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=with_ids, verify=verify)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def page_redirects(pages: DataFrame) -> DataFrame:
    """A stated table of redirects (a, b): of each twenty pages the first leads to the eleventh, and some of these go on."""
    urls = pages.select("page_id", "url")
    hops = urls.where("page_id % 20 = 0 or page_id % 60 = 10").select(F.col("url").alias("a"), (F.col("page_id") + 10).alias("to"))
    return hops.join(urls.select(F.col("page_id").alias("to"), F.col("url").alias("b")), "to").select("a", "b")


def url_alias_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that spread over redirects, for which the tables' pages have no links of their own."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES, page_redirects(pages))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_OP1 = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
o AS (SELECT h, min(page_id) AS owner FROM q WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to, p.url, true AS digest_ok
FROM q JOIN p USING (page_id) LEFT JOIN o USING (h)
"""

# The share of equal lines is found by hash; candidates for one edit share a half.
_OP3 = r"""
WITH o AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT line, min({'d': doc_id, 'k': k}) AS first, length(line) AS n FROM o
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), b AS (
  SELECT line, first, n, unnest([n, n - 1]) AS base FROM f
), h AS (
  SELECT line, first, n, base, 'p' AS side, left(line, base // 2) AS half FROM b
  UNION ALL SELECT line, first, n, base, 's', right(line, base - base // 2) FROM b
), c AS (
  SELECT DISTINCT x.line AS late, y.line AS early, x.n AS nl, y.n AS ne
  FROM h AS x JOIN h AS y ON x.base = y.base AND x.side = y.side AND x.half = y.half AND y.first < x.first
), e AS (
  SELECT DISTINCT late FROM c WHERE abs(nl - ne) <= 1 AND (
    nl = ne AND len(list_filter(range(1, nl + 1), lambda i: late[i] <> early[i])) <= 1
    OR nl > ne AND len(list_filter(range(1, nl + 1), lambda i: left(late, i - 1) || substr(late, i + 1) = early)) > 0
    OR nl < ne AND len(list_filter(range(1, ne + 1), lambda i: left(early, i - 1) || substr(early, i + 1) = late)) > 0)
), g AS (
  SELECT o.doc_id, o.k, o.line, f.first IS NOT NULL AND (f.first <> {'d': o.doc_id, 'k': o.k} OR e.late IS NOT NULL) AS gone
  FROM o LEFT JOIN f ON f.line = o.line LEFT JOIN e ON e.late = o.line
), r AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::BIGINT)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents AS d LEFT JOIN r USING (doc_id)
"""

_OP4 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

_OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), l AS (
  SELECT *, depth, h >> (60 - depth) AS prefix FROM d, range(0, 61) AS r(depth)
), s AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL
), m AS (
  SELECT doc_id, h, n_bytes, min(depth) AS depth FROM l JOIN s USING (depth, prefix)
  WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60 GROUP BY ALL
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes,
       's' || CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - m.depth)), m.depth::INTEGER, '0') END AS shard,
       m.depth::INTEGER AS depth, shard_bytes, shard_rows
FROM m JOIN s ON s.depth = m.depth AND s.prefix = m.h >> (60 - m.depth)
"""

_OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT_WORDS} + 2)) AS i FROM d
), k AS (
  SELECT doc_id, i, array_to_string(w[i:i + {REPEAT_WORDS} - 1], ' ') AS x FROM s
), r AS (
  SELECT x FROM k GROUP BY x HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WORDS})) AS p FROM k SEMI JOIN r USING (x))
), l AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
), e AS (
  SELECT d.doc_id, d.w, coalesce(l.gone, []) AS gone FROM d LEFT JOIN l USING (doc_id)
), f AS (
  SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
         list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) AS kept
  FROM e
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM f
"""

# Laid over each other wherever they have a token in common; no seeds.
_OP10 = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v FROM benchmark
), dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
bp AS (SELECT item_id, least(len(v), {decontamination.WINDOW}) AS width, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS q FROM b),
a AS (
  SELECT doc_id, item_id, width, n, list(q) AS places
  FROM dp JOIN bp USING (x) GROUP BY doc_id, item_id, width, n, p - q
  HAVING count(*) >= ceil(width * {decontamination.SHARE})
), y AS (
  SELECT DISTINCT doc_id, item_id FROM a
  WHERE list_max(list_transform(range(1, n - width + 2), lambda s: len(list_filter(places, lambda q: q >= s AND q < s + width)))) >= ceil(width * {decontamination.SHARE})
), z AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids FROM y GROUP BY doc_id)
SELECT documents.doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids
FROM documents LEFT JOIN z ON documents.doc_id = z.doc_id
"""

_HOSTS = """
u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, name, prefix) AS (VALUES %s),
m AS (
  SELECT page_id, name || prefix AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(name || prefix) DESC) AS k
  FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
), j AS (
  SELECT h.page_id, url, host, path, rule, verdict FROM h LEFT JOIN (SELECT * FROM m WHERE k = 1) AS m ON h.page_id = m.page_id
)
""" % ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

# No page of the tables states a canonical link or a refresh, so no page has an alias.
_OP9 = f"WITH {_HOSTS} SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, false AS alias_blocked FROM j"

# Every page that the links of a page reach; a blocked one among them blocks it.
_ALIASES = f"""
WITH RECURSIVE {_HOSTS}, n AS (
  SELECT *, regexp_replace(regexp_extract(url, '^[^#]*'), '^([^:]*)://[^/?#]*', lower(regexp_extract(url, '^[^:]*')) || '://' || host) AS key FROM j
), s AS (
  SELECT x.key AS a, y.key AS b FROM n AS x JOIN n AS y ON y.page_id = x.page_id + 10
  WHERE (x.page_id % 20 = 0 OR x.page_id % 60 = 10) AND x.key <> y.key
), e AS (
  SELECT a, b FROM s UNION SELECT b, a FROM s
), c(a, b) AS (
  SELECT a, a FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
), x AS (
  SELECT DISTINCT c.a AS key FROM c JOIN n ON n.key = c.b WHERE verdict = 'block'
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN x.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, x.key IS NOT NULL AS alias_blocked
FROM n LEFT JOIN x ON x.key = n.key
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_warc, op2_quality, op3_line_dedup, op4_exact_dedup, op5_sharding, op6_substring_dedup, op7_simhash, op8_bpe, op9_url_filter, op10_decontamination, url_alias_blocks)
    return {f.__name__: f for f in each} | phrase_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": _OP1,
        "op3_line_dedup": _OP3,
        "op4_exact_dedup": _OP4,
        "op5_sharding": _OP5,
        "op6_substring_dedup": _OP6,
        "op9_url_filter": _OP9,
        "url_alias_blocks": _ALIASES,
        "op10_decontamination": _OP10,
    } | phrase_queries.oracle_sql()
