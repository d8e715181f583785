"""The ingest chain and query parsing over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, understanding
from ..operators import ingest as chain
from .registry import query, table
from .text import _CLEANED, DOMAIN, KINDS, LATIN, _hits

POOLS = {"licence": "legal", "german": "foreign", "french": "foreign"}
DETECT: list[tuple[str, list[str] | str, int]] = [("licence text", ["license", "rights reserved", "license terms"], 2), ("numbered", r"\d+\.\d+\.\d+", 1), ("prose", ["the", "and", "that", "with"], 3)]
RULES = chain.Rules(DOMAIN, KINDS, LATIN, 80, 0.7, ("html", "urls", "emails", "control", "whitespace"), detector=DETECT, sure=0.5, pools=POOLS, head=None)
_ALL = sorted({w for _, rule, _ in DETECT if not isinstance(rule, str) for w in rule}, key=lambda w: (-len(w), w))


def _detected(text: str) -> str:
    tests = [f"WHEN {f'len(list_intersect(dh, {rule!r})) >= {least}' if not isinstance(rule, str) else f'regexp_matches({text}, $${rule}$$)'} THEN '{name}'" for name, rule, least in DETECT]
    return f"CASE WHEN trim({text}) = '' THEN 'other' {' '.join(tests)} ELSE 'other' END"


_CHAIN = f"""
ic AS (SELECT doc_id, lang, text AS raw, {_CLEANED.format("text")} AS t FROM documents),
ig AS (SELECT *, {' + '.join(f"contains(lower(t), '{w}')::INT" for w in DOMAIN)} AS hits,
  (length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g'))) / greatest(length(t), 1) AS letters,
  list_distinct(regexp_extract_all(t, '{"|".join(_ALL)}')) AS dh, [{", ".join(_hits(w).replace("text", "t") for w in KINDS.values())}] AS kn FROM ic),
ir AS (SELECT *, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'empty' WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 80 THEN 'short'
  WHEN letters < 0.7 OR hits = 0 THEN 'irrelevant' END AS reject_reason FROM ig),
it AS (SELECT *, CASE WHEN reject_reason IS NULL THEN CASE WHEN round(least(1.0, list_max(kn) / 3), 4) < 0.5 THEN {_detected("t")}
  WHEN list_max(kn) = 0 THEN 'other' ELSE {list(KINDS)!r}[list_position(kn, list_max(kn))] END END AS doc_type FROM ir),
ip AS (SELECT doc_id, lang, reject_reason, doc_type, CASE WHEN reject_reason IS NULL THEN CASE doc_type WHEN 'licence' THEN 'legal' WHEN 'german' THEN 'foreign' WHEN 'french' THEN 'foreign' ELSE 'general' END END AS pool,
  CASE WHEN reject_reason IS NULL THEN hits END AS keywords, CASE WHEN reject_reason IS NULL THEN length(t) END AS text_length FROM it)
"""


@query(f"WITH {_CHAIN} SELECT doc_id, reject_reason, doc_type, pool, keywords, text_length FROM ip")
def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its reason of rejection, or its class and pool."""
    rows = chain.ingest(table(spark, sf_dir, "documents"), RULES)
    return rows.select("doc_id", "reject_reason", "doc_type", "pool", "keywords", "text_length")


@query(f"WITH {_CHAIN} SELECT lang, pool, coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM ip GROUP BY ALL")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.outcome_counts(chain.ingest(table(spark, sf_dir, "documents"), RULES), ["lang", "pool"])


@query(f"""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '{"|".join(_ALL)}')) AS dh FROM documents) SELECT doc_id, {_detected("text")} AS label FROM d""")
def document_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", predicates.document_detector(F.col("text"), DETECT).alias("label"))


CLASSES = [("finance", 2.0, ["ring", "widget", "red widget"]), ("industry", 1.5, ["bolt", "gear"]), ("action", 1.0, ["red", "blue"])]
STOP = ["small", "hot"]
CONCEPTS = [("ring", "circle"), ("gear", "machine"), ("gear", "transmission"), ("red", "colour"), ("blue", "colour")]
SYNONYMS = [("ring", 1), ("hoop", 1), ("band", 1), ("bolt", 2), ("screw", 2)]
_FIRST = {w: (weight, name) for name, weight, words in reversed(CLASSES) for w in words}
_GONE = sorted(_FIRST, key=lambda w: (-len(w), w)) + STOP


def _replaced(text: str) -> str:
    for w in _GONE:
        text = f"replace({text}, '{w}', ' ')"
    return text


_PARSED = f"""
pq AS (SELECT p_partkey AS query_id, lower(p_name) AS t FROM part),
pd(term, weight, origin) AS (VALUES {", ".join(f"('{w}', {x[0]}::DOUBLE, '{x[1]}')" for w, x in _FIRST.items())}),
pk AS (SELECT query_id, term, weight, origin FROM pq JOIN pd ON contains(t, term)),
pr AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all({_replaced("t")}, '[a-zA-Z]+|\\d+')) AS term FROM pq) WHERE length(term) > 1 AND term NOT IN ({", ".join(f"'{w}'" for w in [*_FIRST, *STOP])})),
parsed AS (SELECT * FROM pk UNION ALL SELECT query_id, term, 1.0::DOUBLE, 'residual' FROM pr)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts as queries."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("q"))
    return rows.select("query_id", understanding.weighted_keywords(F.col("q"), CLASSES, STOP).alias("k"))


@query(f"WITH {_PARSED} SELECT * FROM parsed")
def parsed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words by class and what is left of a query."""
    return _parsed(spark, sf_dir).select("query_id", F.explode("k").alias("x")).select("query_id", "x.*")


@query(
    f"""WITH {_PARSED}, s(term, g) AS (VALUES {", ".join(f"('{t}', {g})" for t, g in SYNONYMS)}), c(term, related) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in CONCEPTS)}),
b AS (SELECT query_id FROM parsed GROUP BY query_id HAVING NOT bool_or(origin = 'residual')),
x AS (SELECT query_id, s2.term, 1.5::DOUBLE AS weight FROM parsed JOIN s AS s1 USING (term) JOIN s AS s2 ON s1.g = s2.g
  UNION ALL SELECT query_id, related, 0.6::DOUBLE FROM parsed JOIN b USING (query_id) JOIN c USING (term)),
y AS (SELECT query_id, term, max(weight) AS weight FROM x GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS n FROM y ANTI JOIN parsed USING (query_id, term))
SELECT query_id, term, weight FROM z WHERE n <= 10"""
)
def parsed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms of a query's words, and related concepts where the query has no intent of its own."""
    rows = _parsed(spark, sf_dir)
    terms = rows.select("query_id", understanding.has_specific_intent(F.col("k")).alias("specific"), F.explode("k.term").alias("term"))
    synonyms, concepts = spark.createDataFrame(SYNONYMS, "term string, group_id int"), spark.createDataFrame(CONCEPTS, "term string, related string")
    return understanding.expand(terms, synonyms, concepts=concepts)


#: How orders write their date; the last is none that is known.
DATE_FORMS = ("yyyy-MM-dd", "yyyy年M月d日", "yyyyMMdd", "MMM yyyy")


@query("SELECT o_orderkey, o_orderdate::DATE AS gte, o_orderdate::DATE AS lte FROM orders WHERE o_orderkey % 4 < 3")
def query_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that texts name, as a range to search in; the texts are orders with their dates in several forms."""
    day = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in DATE_FORMS)), (F.col("o_orderkey") % len(DATE_FORMS) + 1).cast("int"))
    text = F.concat(F.lit("order of "), day, F.lit(" by "), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", understanding.date_range(text, F.lit("2024-01-01").cast("date")).alias("r"))
    return rows.select("o_orderkey", "r.gte", "r.lte").where("gte is not null")
