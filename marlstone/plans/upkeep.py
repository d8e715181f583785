"""Evidence, vector store upkeep, stage scores and dictionaries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, knowledge, scorecard, vectors
from . import search
from .registry import query, table

_ROUNDS = """
er AS (SELECT vec_id // 20 AS query_id, (vec_id % 3)::INT AS round, 'label ' || label AS text, 'v' || (vec_id % 7) AS source, round(abs(embedding[1]::DOUBLE), 4) AS score FROM embeddings)
"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence made of vectors: twenty finds a query, in three rounds, with their label as text."""
    key = F.col("vec_id")
    score = F.round(F.abs(F.element_at("embedding", 1).cast("double")), 4)
    return table(spark, sf_dir, "embeddings").select(F.floor(key / 20).alias("query_id"), (key % 3).cast("int").alias("round"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.concat(F.lit("v"), (key % 7).cast("string")).alias("source"), score.alias("score"))


@query(
    f"""WITH {_ROUNDS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY round, score DESC, source) AS k FROM er WHERE score >= 0.05)
SELECT query_id, text, round, source, score FROM f WHERE k = 1"""
)
def evidence_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rounds_deduplicated(_rounds(spark, sf_dir), 0.05)


@query(f"WITH {_ROUNDS} SELECT query_id, round, count(*) AS n_found, max(score) AS best FROM er GROUP BY ALL")
def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.round_trace(_rounds(spark, sf_dir))


_FOLLOW = f"""{_ROUNDS}, p AS (SELECT query_id, text, source, score, CASE WHEN round = 0 THEN 0 ELSE 1 END AS part FROM er),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY part, score DESC, source) AS k FROM p),
fa AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, score DESC, text) AS place, text, source, score FROM o WHERE k = 1)
"""


def _followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounds(spark, sf_dir)
    return evidence.assembled([rows.where("round = 0"), rows.where("round > 0")])


@query(f"WITH {_FOLLOW} SELECT query_id, place::INT AS place, text, source, score FROM fa")
def followup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation has already, then what is new, texts once, numbered from 1."""
    return _followup(spark, sf_dir)


@query(
    f"""WITH {_FOLLOW} SELECT query_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT query_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '[cut]' ELSE t END AS t FROM (
  SELECT query_id, string_agg('[' || place || ']  - source: ' || source || chr(10) || substr(text, 1, 6), chr(10) || chr(10) ORDER BY place) AS t FROM fa GROUP BY query_id))"""
)
def sources_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = evidence.sources_text(_followup(spark, sf_dir).withColumns({"title": none, "date": none}), 6, 60, "[cut]")
    return rows.select("query_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(
    f"""WITH {search._JACCARD}, h AS (SELECT query_id, source, min(rank) AS rank, count(*) AS n FROM ja JOIN documents ON key = doc_id GROUP BY ALL)
SELECT query_id, sum(n)::BIGINT AS n_hits, list(source ORDER BY rank, source) AS documents FROM h GROUP BY query_id"""
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    return evidence.provenance(docs.join(search.found_few(search.jaccard_search(spark, sf_dir)), "key"))


@query(
    """WITH s AS (SELECT vec_id AS key, label, 1 AS version FROM embeddings WHERE label <> 1),
n AS (SELECT vec_id AS key, label + 100 AS label, 2 AS version FROM embeddings WHERE label IN (1, 2)),
u AS (SELECT * FROM s ANTI JOIN n USING (key) UNION ALL SELECT * FROM n)
SELECT version, label, count(*) AS n FROM u WHERE label <> 3 GROUP BY ALL"""
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all labels but 1, to which 1 and 2 come anew and from which 3 goes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    store = rows.where("label <> 1").withColumn("version", F.lit(1))
    new = rows.where("label in (1, 2)").withColumn("label", F.col("label") + 100)
    left = vectors.removed(vectors.upserted(store, new, 2), rows.where("label = 3"))
    return left.groupBy("version", "label").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id AS key FROM documents WHERE lang <> 'fr'), v AS (SELECT vec_id AS key FROM embeddings)
SELECT state, count(*) AS n FROM (SELECT 'missing' AS state FROM d ANTI JOIN v USING (key) UNION ALL SELECT 'extra' FROM v ANTI JOIN d USING (key)) GROUP BY state"""
)
def vector_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("key"))
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return vectors.missing_and_extra(store, docs).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT md5(coalesce(text, '')) AS h, lang FROM documents), c AS (SELECT DISTINCT h FROM h WHERE lang = 'en')
SELECT CASE WHEN c.h IS NULL THEN 'miss' ELSE 'hit' END AS state, count(*) AS n FROM h LEFT JOIN c USING (h) GROUP BY 1"""
)
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that knows the English texts; the others are embedded, here by their length."""
    docs = table(spark, sf_dir, "documents")
    one = F.array(F.length(F.coalesce("text", F.lit(""))).cast("double"))
    cache = docs.where("lang = 'en'").select(vectors.text_hash(F.col("text")).alias("text_hash"), one.alias("vector")).dropDuplicates(["text_hash"])
    found, _ = vectors.embedded(docs, cache, lambda rows: rows.select("text_hash", one.alias("vector")), 1, "doc_id")
    return vectors.cache_report(found)


_SCORES = f"""{search._BM25}, {search._JACCARD},
qt AS (SELECT item_id AS query_id, count(DISTINCT t) AS n_terms FROM (SELECT item_id, unnest({search._TOKENS.format("text")}) AS t FROM benchmark) GROUP BY 1),
b AS (SELECT query_id, count(*) AS n, max(score) AS top FROM bm GROUP BY 1), j AS (SELECT query_id, count(*) AS n, max(score) AS top FROM ja GROUP BY 1),
f AS (SELECT query_id, count(*) AS fused, sum((c = 2)::INT) AS consensus FROM (SELECT query_id, key, count(*) AS c FROM (SELECT query_id, key FROM bm UNION ALL SELECT query_id, key FROM ja) GROUP BY ALL) GROUP BY 1),
st AS (SELECT query_id, n_terms, b.n AS bn, b.top AS bt, j.n AS jn, j.top AS jt, fused, consensus FROM b JOIN j USING (query_id) JOIN f USING (query_id) JOIN qt USING (query_id))
"""


@query(
    f"""WITH {_SCORES} SELECT query_id, round(0.4::DOUBLE * n_terms / greatest(n_terms, 1) + 0.6::DOUBLE * least(1.0, bt * 2), 6) AS terms, round(0.3::DOUBLE * least(1.0, jn / 5) + 0.7::DOUBLE * least(1.0, jt * 1.5), 6) AS overlap,
round(0.5::DOUBLE * consensus / greatest(fused, 1) + 0.3::DOUBLE * (1 - abs(bn - jn) / greatest(bn + jn, 1)) + 0.2::DOUBLE * least(1.0, fused / 5), 6) AS fusion,
round(0.5::DOUBLE * least(1.0, jt * 1.2) + 0.5::DOUBLE * consensus / greatest(jn, 1), 6) AS rerank FROM st"""
)
def retrieval_stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the stages of each search; the overlap stands for the vectors, common hits for high ones."""
    from ..functions.tokens import index_terms

    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.size(F.array_distinct(index_terms(F.col("text")))).alias("n_terms"))
    hits = search._both(spark, sf_dir)
    of = lambda name: F.col("channel") == name
    sides = hits.groupBy("query_id").agg(*(f(F.when(of(c), F.col("score"))).alias(f"{c}_{n}") for c in ("bm25", "jaccard") for n, f in (("n", F.count), ("top", F.max))))
    both = hits.groupBy("query_id", "key").agg(F.count("*").alias("c")).groupBy("query_id").agg(F.count("*").alias("fused"), F.sum((F.col("c") == 2).cast("long")).alias("consensus"))
    rows = sides.where("bm25_n > 0 and jaccard_n > 0").join(both, "query_id").join(terms, "query_id")
    c = F.col
    return rows.select(
        "query_id",
        F.round(scorecard.term_search_score(c("n_terms"), c("n_terms"), c("bm25_top")), 6).alias("terms"),
        F.round(scorecard.vector_search_score(c("jaccard_n"), c("jaccard_top")), 6).alias("overlap"),
        F.round(scorecard.fusion_score(c("fused"), c("bm25_n"), c("jaccard_n"), c("consensus")), 6).alias("fusion"),
        F.round(scorecard.rerank_score(c("jaccard_n"), c("jaccard_top"), c("consensus")), 6).alias("rerank"),
    )


@query(
    """WITH s AS (SELECT count(*) AS n_docs, sum((trim(coalesce(text, '')) = '')::BIGINT)::BIGINT AS n_empty FROM documents),
v AS (SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents))
SELECT n_docs, n_empty, vocabulary, round(0.35::DOUBLE * least(1.0, vocabulary / greatest(n_docs, 1) / 100) + 0.35::DOUBLE * (n_docs - n_empty) / greatest(n_docs, 1) + 0.3::DOUBLE / 2, 4) AS score FROM s, v"""
)
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return scorecard.index_health(table(spark, sf_dir, "documents"), "text", words, 2, 1)


@query(
    """WITH s AS (SELECT user_id AS run, event_type AS stage, round(avg(value) / 100, 8) AS score FROM events GROUP BY ALL)
SELECT run, stage, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, stage) AS place FROM s) WHERE place <= 3"""
)
def worst_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg(F.round(F.avg("value") / 100, 8).alias("score"))
    return scorecard.worst_stages(rows, 3)


DICTIONARY = ["license", "the", "und", "zebra", "les", "rights", "quagga"]


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), t AS (SELECT unnest({DICTIONARY}) AS term)
SELECT term, count(DISTINCT doc_id) AS documents, count(doc_id) AS occurrences, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 4) AS hit_rate FROM t LEFT JOIN w USING (term) GROUP BY term"""
)
def dictionary_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the terms of a dictionary occur; missing ones have zero."""
    terms = spark.createDataFrame([(t,) for t in DICTIONARY], "term string")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return knowledge.dictionary_use(table(spark, sf_dir, "documents"), terms, words)


@query(
    r"""WITH t AS (SELECT lang, length(text) AS n, (length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) / greatest(length(text), 1) AS share,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(regexp_replace(p, '^[\s\x0B\x{00A0}\x{3000}]+|[\s\x0B\x{00A0}\x{3000}]+$', '', 'g')) > 20)) AS paras,
  (length(regexp_replace(text, '^[\s\x0B\x{00A0}\x{3000}]+|[\s\x0B\x{00A0}\x{3000}]+$', '', 'g')) < 10)::INT AS empty FROM (SELECT lang, coalesce(text, '') AS text FROM documents)),
g AS (SELECT lang, count(*) AS doc_count, avg(n) AS l, avg(share) AS r, avg(paras) AS p, sum(empty)::BIGINT AS empty_docs FROM t GROUP BY lang),
s AS (SELECT *, 0.4::DOUBLE * least(1.0, r / 0.3::DOUBLE * 0.5::DOUBLE + least(p / 5, 1.0::DOUBLE) * 0.5::DOUBLE)
  + 0.3::DOUBLE * CASE WHEN l < 50 THEN l / 50 WHEN l <= 5000 THEN 1.0 ELSE greatest(0.5::DOUBLE, 1 - (l - 5000) / 20000) END + 0.3::DOUBLE * (1 - empty_docs / doc_count) AS score FROM g)
SELECT lang, doc_count, empty_docs, round(l, 4) AS avg_length, round(r, 6) AS script_ratio, round(p, 6) AS avg_paragraphs, round(score, 6) AS score,
  CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.75 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM s"""
)
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good the documents of each language are to index, by small Latin letters."""
    rows = scorecard.text_scores(table(spark, sf_dir, "documents"), ["lang"], "[a-z]")
    return rows.select("lang", "doc_count", "empty_docs", F.round("avg_length", 4).alias("avg_length"), F.round("script_ratio", 6).alias("script_ratio"), F.round("avg_paragraphs", 6).alias("avg_paragraphs"), F.round("score", 6).alias("score"), "grade")


@query(
    """WITH c AS (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents),
t AS (SELECT lang, length(text) AS n, (substr(text, -1) IN ('。', '！', '？', '；', '.', '!', '?'))::INT AS ended FROM c),
g AS (SELECT lang, count(*) AS chunk_count, avg(n) AS m, min(n) AS min_size, max(n) AS max_size, stddev_pop(n) AS sd, avg(ended) AS b, avg((n < 50)::INT) AS sm, avg((n > 750)::INT) AS o FROM t GROUP BY lang),
s AS (SELECT *, greatest(0.0::DOUBLE, 1 - sd / greatest(m, 1.0::DOUBLE) * 0.8::DOUBLE) AS u FROM g), f AS (SELECT *, u * 0.35::DOUBLE + b * 0.35::DOUBLE + greatest(0.0::DOUBLE, 1 - sm * 3) * 0.3::DOUBLE AS score FROM s)
SELECT lang, chunk_count, min_size::INT AS min_size, max_size::INT AS max_size, round(m, 4) AS avg_size, round(sd, 4) AS std_dev, round(u, 6) AS uniformity, round(b, 6) AS boundary_quality,
  round(sm, 6) AS small_chunk_ratio, round(o, 6) AS oversized_ratio, round(score, 6) AS score FROM f"""
)
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How even the lines of the documents of each language are, taken as chunks."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    rows = scorecard.chunk_scores(lines, ["lang"])
    shown = {"avg_size": 4, "std_dev": 4, "uniformity": 6, "boundary_quality": 6, "small_chunk_ratio": 6, "oversized_ratio": 6, "score": 6}
    return rows.select("lang", "chunk_count", "min_size", "max_size", *(F.round(c, n).alias(c) for c, n in shown.items()))
