"""Cleaning, gating, classification, extraction and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, extraction, predicates, tokens
from ..operators import chunking
from .registry import query, table

#: Words and scripts of the test corpus; the corpus is not Chinese.
DOMAIN = ["licensed", "rights", "the", "und", "les", "que"]
LATIN = r"\p{L}"
KINDS = {"licence": ["license", "licensed", "rights reserved"], "english": ["the", "and", "that"], "german": ["der", "und", "die"], "french": ["les", "une", "dans"]}
INTENTS = {"legal": (["license", "rights"], [r"(?i)version \d"]), "tabular": (["|"], [r"\|[^|]+\|"]), "contact": (["@"], [r"\d{3}-\d{4}"])}
NAMES = {"MIT License": "MIT", "Apache License, Version 2.0": "Apache", "GNU General Public License": "GPL", "CC BY-NC 4.0": "CC"}


_URL = r"[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+"
#: The steps html, urls, emails, control and whitespace; RE2 has no back references, so repeated characters are left out.
_CLEANED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), "
    f"'https?://{_URL}|www\\.{_URL}', '', 'g'), "
    r"'[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), "
    r"'\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '([，。！？；：])[ \t]+', '\1', 'g')"
)


@query(
    r"""
SELECT page_id, length(html) AS before_chars, length(c) AS after_chars, md5(c) AS cleaned_md5,
       round(CASE WHEN length(html) > 0 THEN length(c) / length(html) ELSE 1.0 END, 4) AS retention,
       length(c) > 0 AND length(html) > 0 AND length(c) / length(html) < 0.3 AS over_cleaned,
       length(html) > 0 AND length(c) = 0 AS emptied
FROM (SELECT page_id, html, """
    + _CLEANED.format("html")
    + r""" AS c FROM pages)
"""
)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning steps that RE2 can express, in order, with their statistics."""
    rows = table(spark, sf_dir, "pages")
    cleaned = cleaning.clean(F.col("html"), ("html", "urls", "emails", "control", "whitespace"))
    rows = rows.select("page_id", "html", cleaned.alias("c"))
    return rows.select("page_id", F.length("html").alias("before_chars"), F.length("c").alias("after_chars"), F.md5("c").alias("cleaned_md5"), *cleaning.clean_statistics(F.col("html"), F.col("c")))


@query()
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps; NFKC and repeated characters have no SQL form."""
    rows = cleaning.clean_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "c")
    return rows.select("doc_id", F.md5("c").alias("cleaned_md5"), *cleaning.clean_statistics(F.col("text"), F.col("c")))


@query(
    """
SELECT doc_id, n_paragraphs, md5(coalesce(string_agg(p, chr(10) ORDER BY i), '')) AS deduped_md5 FROM (
  SELECT doc_id, p, i, len(ps) AS n_paragraphs, row_number() OVER (PARTITION BY doc_id, trim(p) ORDER BY i) AS k
  FROM (SELECT doc_id, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))
) WHERE k = 1 OR trim(p) = '' GROUP BY doc_id, n_paragraphs
"""
)
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_paragraphs"), F.md5(cleaning.dedup_paragraphs(text, "\n")).alias("deduped_md5"))


@query(
    """
SELECT doc_id, md5(coalesce(string_agg(p, chr(10) ORDER BY i), '')) AS kept_md5, count(*) AS n_lines FROM (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)
) WHERE NOT regexp_matches(p, '(?i)^.{0,20}(all rights reserved|mit license|cc by-nc).{0,20}$') GROUP BY doc_id
"""
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.drop_boilerplate(F.col("text"), ("all rights reserved", "mit license", "cc by-nc"))
    rows = table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"))
    return rows.where("kept <> ''").select("doc_id", F.md5("kept").alias("kept_md5"), F.size(F.split("kept", "\n", -1)).cast("long").alias("n_lines"))


@query(
    """
SELECT doc_id, lang, n_chars FROM documents
WHERE lang IN ('en', 'de') AND n_chars >= 200 AND n_chars < 5000 AND source <> 'src0' AND regexp_matches(source, '^src[0-9]$')
  AND NOT (lang = 'de' AND n_chars < 400)
"""
)
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"lang": ["en", "de"], "n_chars": {"$gte": 200, "lt": 5000}, "source": {"$ne": "src0", "regex": "^src[0-9]$"}, "$not": {"lang": "de", "n_chars": {"$lt": 400}}}
    return table(spark, sf_dir, "documents").where(predicates.metadata_filter(tree)).select("doc_id", "lang", "n_chars")


@query(
    r"""
SELECT coalesce(reason, 'passed') AS outcome, count(*) AS n, sum(hits)::BIGINT AS hits FROM (
  SELECT CASE WHEN length(text) < 100 THEN 'too_short'
    WHEN (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) / length(text) < 0.75 THEN 'script'
    WHEN hits = 0 THEN 'no_keyword' END AS reason, hits
  FROM (SELECT text, contains(lower(text), 'licensed')::INT + contains(lower(text), 'rights')::INT + contains(lower(text), 'the')::INT
    + contains(lower(text), 'und')::INT + contains(lower(text), 'les')::INT + contains(lower(text), 'que')::INT AS hits FROM documents)
) GROUP BY 1
"""
)
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the gate: rejected by length, script or words, or passed."""
    gate = predicates.relevance_gate(F.col("text"), DOMAIN, LATIN, 100, 0.75)
    rows = table(spark, sf_dir, "documents").select(gate.alias("g"))
    return rows.groupBy(F.coalesce("g.reason", F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("g.hits").alias("hits"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"contains(text, '{w}')::INT" for w in words)


@query(
    f"""
WITH s AS (SELECT doc_id, [{", ".join(_hits(w) for w in KINDS.values())}] AS n FROM documents)
SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 'other' ELSE {list(KINDS)!r}[list_position(n, list_max(n))] END AS label,
       round(least(1.0, list_max(n) / 3), 4) AS confidence FROM s
"""
)
def document_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", predicates.keyword_class(F.col("text"), KINDS).alias("c")).select("doc_id", "c.*")


@query(
    r"""
WITH s AS (SELECT doc_id, [
  least(1.0, round(0.3 * (contains(lower(text), 'license')::INT + contains(lower(text), 'rights')::INT) + 0.4 * regexp_matches(text, '(?i)version \d')::INT, 4)),
  least(1.0, round(0.3 * contains(lower(text), '|')::INT + 0.4 * regexp_matches(text, '\|[^|]+\|')::INT, 4)),
  least(1.0, round(0.3 * contains(lower(text), '@')::INT + 0.4 * regexp_matches(text, '\d{3}-\d{4}')::INT, 4))] AS n FROM documents)
SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 'general' ELSE ['legal', 'tabular', 'contact'][list_position(n, list_max(n))] END AS intent,
       CASE WHEN list_max(n) = 0 THEN 0.5 ELSE list_max(n)::DOUBLE END AS score FROM s
"""
)
def intent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", predicates.intent_class(F.col("text"), INTENTS).alias("c")).select("doc_id", "c.intent", F.col("c.score").cast("double").alias("score"))


@query("SELECT doc_id, source, contains(lower(text), 'license') AS in_text FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.knowledge import keyword_match

    return table(spark, sf_dir, "documents").where(keyword_match("license")).select("doc_id", "source", F.contains(F.lower("text"), F.lit("license")).alias("in_text"))


@query(
    """
SELECT lang, sum(CASE WHEN contains(text, 'Apache') OR contains(text, 'MIT') THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) AS n
FROM documents GROUP BY lang
"""
)
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news filter: any part of a comma list of two characters or more."""
    match = predicates.keyword_filter(F.col("text"), "Apache，MIT, x")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(match.cast("long")).alias("matched"), F.count("*").alias("n"))


@query(
    r"""
SELECT doc_id,
  CASE WHEN contains(text, 'Apache License, Version 2.0') THEN 'Apache' WHEN contains(text, 'GNU General Public License') THEN 'GPL'
       WHEN contains(text, 'CC BY-NC 4.0') THEN 'CC' WHEN contains(text, 'MIT License') THEN 'MIT' END AS company,
  CASE WHEN regexp_matches(text, '\d{4}\s*[QH]\d') THEN regexp_extract(text, '(\d{4})\s*([QH]\d)', 1) || '-' || CASE regexp_extract(text, '(\d{4})\s*([QH]\d)', 2)
         WHEN 'Q1' THEN '03' WHEN 'Q2' THEN '06' WHEN 'H1' THEN '06' WHEN 'Q3' THEN '09' ELSE '12' END
       WHEN regexp_matches(text, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') THEN regexp_extract(text, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 1) || '-' ||
         lpad(regexp_extract(text, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(text, '(\d{4})[-/](\d{1,2})[-/](\d{1,2})', 3), 2, '0')
       WHEN regexp_matches(text, '\d{4}[-/]\d{1,2}') THEN regexp_extract(text, '(\d{4})[-/](\d{1,2})', 1) || '-' || lpad(regexp_extract(text, '(\d{4})[-/](\d{1,2})', 2), 2, '0')
       WHEN regexp_matches(text, '\d{8}') THEN substr(regexp_extract(text, '\d{8}'), 1, 4) || '-' || substr(regexp_extract(text, '\d{8}'), 5, 2) || '-' || substr(regexp_extract(text, '\d{8}'), 7, 2) END AS publish_date,
  CASE WHEN e > 0 AND e >= d AND e >= f THEN 'english' WHEN d > 0 AND d >= f THEN 'german' WHEN f > 0 THEN 'french' END AS sector,
  round((1 + 1 + (CASE WHEN lang <> '' THEN 1 ELSE 0 END)) / 3, 4) AS completeness
FROM (SELECT *, contains(text, 'the')::INT + contains(text, 'and')::INT AS e, contains(text, 'der')::INT + contains(text, 'und')::INT AS d,
      contains(text, 'les')::INT + contains(text, 'une')::INT AS f FROM documents)
"""
)
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company by longest keyword, date by ordered patterns, sector by votes, completeness."""
    text = F.col("text")
    sectors = {"english": ["the", "and"], "german": ["der", "und"], "french": ["les", "une"]}
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        extraction.longest_keyword(text, NAMES).alias("company"),
        extraction.publish_date(text).alias("publish_date"),
        extraction.sector_votes(text, sectors).alias("sector"),
        extraction.completeness([F.col("doc_id"), F.col("source"), F.col("lang")]).alias("completeness"),
    )


@query(
    r"""
SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}'), lambda x: length(x) >= 4)).list_sort() AS entities
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}')
"""
)
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by pattern, here mail addresses; distinct and of four characters or more."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern))
    return rows.select("doc_id", F.sort_array(extraction.pattern_entities(F.col("text"), pattern)).alias("entities"))


@query(
    """
SELECT lang, CASE WHEN u > d THEN 'positive' WHEN d > u THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n FROM (
  SELECT lang, contains(text, 'able')::INT + contains(text, 'best')::INT + contains(text, 'heit')::INT AS u,
         contains(text, 'idiot')::INT + contains(text, 'pathetic')::INT + contains(text, 'clown')::INT AS d FROM documents) GROUP BY ALL
"""
)
def sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = extraction.sentiment(F.col("text"), ["able", "best", "heit"], ["idiot", "pathetic", "clown"])
    return table(spark, sf_dir, "documents").groupBy("lang", mood.alias("sentiment")).agg(F.count("*").alias("n"))


@query(
    """
WITH c AS (SELECT source, len(regexp_extract_all(text, '(?i)license|rights')) AS u, len(regexp_extract_all(text, '(?i)idiot|clown')) AS d FROM documents),
f AS (SELECT source, CASE WHEN u > d THEN 1 WHEN d > u THEN -1 ELSE 0 END AS side, CASE WHEN u = d THEN 2 ELSE least(10, greatest(u, d) + 3) END AS factor FROM c)
SELECT source, sum((side = 1)::BIGINT)::BIGINT AS bullish, sum((side = -1)::BIGINT)::BIGINT AS bearish, count(*) AS n,
       least(10, floor(sum(factor) / count(*)) + 2)::INTEGER AS factor FROM f GROUP BY source
"""
)
def event_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of rules per source and the combined factor."""
    rows = table(spark, sf_dir, "documents").select("source", extraction.event_impact(F.col("text"), "(?i)license|rights", "(?i)idiot|clown").alias("i"))
    side = F.col("i.direction")
    factor = F.least(F.lit(10), F.floor(F.sum("i.factor") / F.count("*")) + 2).cast("int")
    return rows.groupBy("source").agg(F.sum((side == "bullish").cast("long")).alias("bullish"), F.sum((side == "bearish").cast("long")).alias("bearish"), F.count("*").alias("n"), factor.alias("factor"))


@query(
    """
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'neutral' WHEN a > b THEN 'bullish' ELSE 'bearish' END AS verdict FROM (
  SELECT doc_id, CASE WHEN contains(text, 'license') THEN length(text) - strpos(reverse(text), reverse('license')) ELSE 0 END AS a,
         CASE WHEN contains(text, 'idiot') THEN length(text) - strpos(reverse(text), reverse('idiot')) ELSE 0 END AS b FROM documents)
"""
)
def last_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = extraction.last_mentioned(F.col("text"), {"license": "bullish", "idiot": "bearish"})
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query(
    r"""
SELECT lang, sum(ceil(length(text) / 4))::BIGINT AS tokens, min(ceil(length(text) / 4))::BIGINT AS least, max(ceil(length(text) / 4))::BIGINT AS most
FROM documents GROUP BY lang
"""
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("tokens"), F.min(n).alias("least"), F.max(n).alias("most"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks with overlap; tested against their invariants."""
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_id", "chunk_count", "chunk_start", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents),
c AS (SELECT count(*) AS n_tokens, count(DISTINCT t) AS vocabulary, sum((length(t) = 1)::BIGINT)::BIGINT AS junk, count(DISTINCT doc_id) AS covered FROM w)
SELECT n_tokens, vocabulary, junk, covered, round(vocabulary / n_tokens, 6) AS ttr, round(covered / (SELECT count(*) FROM documents), 6) AS coverage FROM c
"""
)
def token_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest quality of tokenisation: type-token ratio, coverage and one-letter junk."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("t")).where("t is not null")
    # Counts per word first, so the distinct words are few when they are counted.
    per_word = words.groupBy("t").agg(F.count("*").alias("n"))
    vocabulary = per_word.agg(F.sum("n").alias("n_tokens"), F.count("*").alias("vocabulary"), F.sum(F.when(F.length("t") == 1, F.col("n")).otherwise(0)).alias("junk"))
    cover = docs.agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.lower("text").rlike("[a-z]"), F.lit(False)).cast("long")).alias("covered"))
    both = vocabulary.crossJoin(cover)  # one row each
    return both.select("n_tokens", "vocabulary", "junk", "covered", F.round(F.col("vocabulary") / F.col("n_tokens"), 6).alias("ttr"), F.round(F.col("covered") / F.col("n_docs"), 6).alias("coverage"))


@query(
    """WITH t AS (SELECT lang IN ('en', 'de') AS a, coalesce(n_chars >= 200 AND n_chars < 5000, false) AS b, coalesce(source <> 'src0', false) AS c FROM documents)
SELECT unnest(['lang', 'n_chars', 'source', 'all']) AS condition, count(*) AS n_rows, unnest([sum(a::BIGINT)::BIGINT, sum(b::BIGINT)::BIGINT, sum(c::BIGINT)::BIGINT, sum((a AND b AND c)::BIGINT)::BIGINT]) AS n_passed FROM t"""
)
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each condition of a filter lets through, and all of them."""
    tree = {"lang": ["en", "de"], "n_chars": {"$gte": 200, "lt": 5000}, "source": {"$ne": "src0"}}
    return predicates.filter_report(table(spark, sf_dir, "documents"), tree)
