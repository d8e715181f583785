"""Query parsing and expansion, score cards, filter evaluation, index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, understanding
from ..operators import retrieval, scorecard
from ..session import share_package
from . import search
from .registry import query, table

WEIGHTS = {"the": 2.0, "that": 3.0, "inth": 1.5}
SYNONYMS = [("the", 1), ("thon", 1), ("zeta", 1), ("alpha", 1), ("that", 2), ("this", 2), ("omega", 2)]
GROUPS = {"click": "retrieval", "view": "retrieval", "purchase": "output", "signup": "output", "error": "ingest"}
GROUP_WEIGHTS = {"retrieval": 0.35, "output": 0.25, "ingest": 0.2}

_TERMS = """
q AS (SELECT item_id AS query_id, lower(text) AS t FROM benchmark),
d(term, weight) AS (VALUES ('inth', 1.5::DOUBLE), ('that', 3.0::DOUBLE), ('the', 2.0::DOUBLE)),
k AS (SELECT query_id, term, weight FROM q JOIN d ON contains(t, term)),
w AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(t, '[a-z]+|\\d+(?:\\.\\d+)?%?')) AS term FROM q)),
terms AS (SELECT * FROM k UNION ALL SELECT query_id, term, 1.0::DOUBLE FROM w ANTI JOIN k USING (query_id, term))
"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), understanding.keywords(F.col("text"), WEIGHTS).alias("k"))
    return rows.select("query_id", F.explode("k").alias("x")).select("query_id", "x.term", "x.weight")


@query(f"WITH {_TERMS} SELECT query_id, term, weight FROM terms")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


@query(
    f"""WITH {_TERMS}, s(term, g) AS (VALUES {", ".join(f"('{t}', {g})" for t, g in SYNONYMS)}),
x AS (SELECT DISTINCT query_id, s2.term FROM terms JOIN s AS s1 USING (term) JOIN s AS s2 ON s1.g = s2.g),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS n FROM x ANTI JOIN terms USING (query_id, term))
SELECT query_id, term, 1.5::DOUBLE AS weight FROM y WHERE n <= 10"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = spark.createDataFrame(SYNONYMS, "term string, group_id int")
    return understanding.expand(_terms(spark, sf_dir).select("query_id", "term"), synonyms)


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'version|vs') THEN 'comparison' WHEN regexp_matches(text, '(?i)reason|analysis') THEN 'analysis'
WHEN regexp_matches(text, '\d') THEN 'factual' ELSE 'other' END AS type FROM documents"""
)
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = (("comparison", "version|vs"), ("analysis", "(?i)reason|analysis"), ("factual", r"\d"))
    return table(spark, sf_dir, "documents").select("doc_id", understanding.query_type(F.col("text"), types).alias("type"))


@query("SELECT event_id, props AS found FROM events")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects that stand within other text."""
    share_package(spark)
    text = F.concat(F.lit("The answer } is: "), F.col("props"), F.lit(" and [more] of {it}."))
    return table(spark, sf_dir, "events").select("event_id", understanding.extract_json(text).alias("found"))


_STAGES = """
s AS (SELECT user_id AS run, event_type AS stage, CASE WHEN event_type IN ('click', 'view') THEN 'retrieval' WHEN event_type IN ('purchase', 'signup') THEN 'output' ELSE 'ingest' END AS grp,
  avg(value) / 100 AS score FROM events GROUP BY ALL),
g AS (SELECT run, grp, avg(score) AS score, min_by(stage, {'a': score, 'b': stage}) AS worst_stage FROM s GROUP BY ALL)
"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg((F.avg("value") / 100).alias("score"))
    return scorecard.group_scores(rows.withColumn("group", names[F.col("stage")]))


@query(f"WITH {_STAGES} SELECT run, grp AS \"group\", round(score, 8) AS score, worst_stage FROM g")
def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("run", "group", F.round("score", 8).alias("score"), "worst_stage")


@query(
    f"""WITH {_STAGES}, o AS (SELECT run, sum(w * score) / greatest(sum(w), 1.0) AS overall
FROM (SELECT *, CASE grp WHEN 'retrieval' THEN 0.35::DOUBLE WHEN 'output' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END AS w FROM g) GROUP BY run)
SELECT run, round(overall, 5) AS overall, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.75 THEN 'B' WHEN overall >= 0.6 THEN 'C' WHEN overall >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM o"""
)
def score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorecard.overall_score(_groups(spark, sf_dir), GROUP_WEIGHTS)
    return out.select("run", F.round("overall", 5).alias("overall"), predicates.grade(F.col("overall")).alias("grade"))


@query(
    f"""WITH {search._JACCARD}
SELECT query_id, count(*) AS n_hits, sum((lang <> 'en')::BIGINT)::BIGINT AS leaks, sum((source = 'src0')::BIGINT)::BIGINT AS trap_hits
FROM ja JOIN documents ON key = doc_id GROUP BY query_id"""
)
def filter_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search without its language filter lets through."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "source")
    return scorecard.filter_leakage(search.jaccard_search(spark, sf_dir), docs.where("lang = 'en'"), docs.where("source = 'src0'"))


@query(
    f"""WITH {search._JACCARD.replace("FROM documents)", "FROM documents WHERE lang = 'en')")} SELECT * FROM ja"""
)
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter before the search, so no allowed document is lost behind the cut."""
    docs = table(spark, sf_dir, "documents").where(predicates.metadata_filter({"lang": "en"}))
    return retrieval.jaccard_search(docs, search._asked(spark, sf_dir), search.TOP)


@query(
    """WITH l AS (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys FROM labels), d AS (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys FROM documents)
SELECT 'documents' AS store, n_rows, n_keys, 0::BIGINT AS missing, 0::BIGINT AS extra FROM d
UNION ALL SELECT 'labels', n_rows, n_keys, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)), (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) FROM l"""
)
def store_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.consistency({"documents": table(spark, sf_dir, "documents"), "labels": table(spark, sf_dir, "labels")}, "doc_id")


@query(
    f"""WITH p AS (SELECT doc_id, unnest({search._TOKENS.format("text")}) AS term FROM documents WHERE lang <> 'fr')
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term"""
)
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all but German, from which French goes and to which all of German comes."""
    docs = table(spark, sf_dir, "documents")
    index = retrieval.postings(docs.where("lang <> 'de'"), "doc_id", "text")
    removed = docs.where("lang = 'fr'").select(F.col("doc_id").alias("key"))
    added = retrieval.postings(docs.where("lang = 'de'"), "doc_id", "text")
    return scorecard.update_postings(index, removed, added).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
