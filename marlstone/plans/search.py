"""Search, fusion, gating, pooling and context queries.

The query set of text searches is the benchmark table, that of vector searches
every vector whose id is divisible by 50; both search all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching
from ..operators import chunking, retrieval, rounds, text_index, vector_index
from ..staging import if_few, new_path, staged
from .registry import query, table

TOP = 10
EVERY = 50


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def found_few(hits: DataFrame) -> DataFrame:
    """Hits that are written before documents are joined to them, so that texts stay where they are if hits are few."""
    return if_few(staged(hits, "hits"))


_TOKENS = r"list_concat(regexp_extract_all(lower({0}), '[a-z]+'), regexp_extract_all(lower({0}), '\d+(?:\.\d+)?%?'))"

_BM25_AT = f"""
bm_d AS (SELECT doc_id AS key, {_TOKENS.format("text")} AS ts FROM documents),
bm_n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM bm_d),
bm_p AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(ts) AS dl, unnest(ts) AS term FROM bm_d) GROUP BY ALL),
bm_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
bm_f AS (SELECT term, count(*) AS df FROM bm_p GROUP BY term),
bm_s AS (SELECT query_id, key, round(sum(qtf * CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 10) AS score
  FROM bm_q JOIN bm_p USING (term) JOIN bm_f USING (term), bm_n GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, round(score, 6) AS score FROM bm_s WHERE score > 0) WHERE rank <= {{0}})
"""
_JACCARD_AT = f"""
ja_d AS (SELECT doc_id AS key, list_distinct({_TOKENS.format("text")}) AS ts FROM documents),
ja_q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS ts FROM benchmark),
ja_c AS (SELECT query_id, key, n, m, count(*) AS c FROM (SELECT key, len(ts) AS n, unnest(ts) AS t FROM ja_d)
  JOIN (SELECT query_id, len(ts) AS m, unnest(ts) AS t FROM ja_q) USING (t) GROUP BY ALL),
ja_s AS (SELECT query_id, key, round(0.7::DOUBLE * c / (n + m - c) + 0.3::DOUBLE * least(1.0::DOUBLE, 200 / n), 10) AS score FROM ja_c),
ja AS (SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, round(score, 6) AS score FROM ja_s) WHERE rank <= {{0}})
"""
_BM25, _JACCARD = _BM25_AT.replace("{0}", "10"), _JACCARD_AT.replace("{0}", "10")
_COSINE = f"""
co_v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings),
co_s AS (SELECT q.key AS query_id, d.key, round(list_cosine_similarity(q.v, d.v), 10) AS score FROM co_v AS q, co_v AS d WHERE q.key % {EVERY} = 0),
co AS (SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, round(score, 6) AS score FROM co_s) WHERE rank <= 10)
"""
_HITS = "hits AS (SELECT *, 'bm25' AS channel FROM bm UNION ALL SELECT *, 'jaccard' FROM ja)"


def _fused(value: str, k: int = 10) -> str:
    return f"""
fused_s AS (SELECT query_id, key, round(sum(0.5 * ({value})), 10) AS score, count(*) AS n_channels FROM (
  SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS scaled
  FROM hits WINDOW w AS (PARTITION BY query_id, channel)) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, round(score, 8) AS score, n_channels FROM fused_s) WHERE rank <= {k})
"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), TOP)


@query(f"WITH {_JACCARD} SELECT * FROM ja")
def jaccard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.jaccard_search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), TOP)


@query(f"WITH {_COSINE} SELECT * FROM co")
def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_search(vectors, vectors.where(F.col("vec_id") % EVERY == 0), TOP)


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against all others through a stored index; recall is measured in a test."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.build(vectors, new_path(spark, "vector-index"))
    return index.search(vectors.where(F.col("vec_id") % EVERY == 0), TOP)


# Of ids by their rest modulo 7: 3 is removed, 5 gets the vector of its label's smallest id.
@query(
    f"""WITH e AS (SELECT vec_id AS key, label, embedding::DOUBLE[] AS v FROM embeddings),
first AS (SELECT label, arg_min(v, key) AS v FROM e GROUP BY label),
d AS (SELECT key, CASE WHEN key % 7 = 5 THEN first.v ELSE e.v END AS v FROM e JOIN first USING (label) WHERE key % 7 <> 3),
s AS (SELECT q.key AS query_id, d.key, round(list_cosine_similarity(q.v, d.v), 10) AS score FROM e AS q, d WHERE q.key % {EVERY} = 0)
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, greatest(round(score, 6), 0) AS score FROM s QUALIFY rank <= {TOP}"""
)
def vector_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal, replacement and compaction of a stored index, read over all its cells."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.build(vectors, new_path(spark, "vector-index"))
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    index.remove(vectors.where("vec_id % 7 = 3"))
    index.add(vectors.where("vec_id % 7 = 5").select("vec_id", "label").join(first, "label"))
    index.compact()
    return index.search(vectors.where(F.col("vec_id") % EVERY == 0), TOP, probes=vector_index.MAX_CELLS)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    index = retrieval.search_index(docs, asked)
    return retrieval.channels({"bm25": retrieval.bm25_search(docs, asked, TOP, index=index), "jaccard": retrieval.jaccard_search(docs, asked, TOP, index=index)})


_EQUAL = {"bm25": 0.5, "jaccard": 0.5}


@query(f"WITH {_BM25}, {_JACCARD}, {_HITS}, {_fused('1 / (60 + rank)')} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_both(spark, sf_dir), _EQUAL, TOP)


@query(f"WITH {_BM25}, {_JACCARD}, {_HITS}, {_fused('scaled')} SELECT * FROM fused")
def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_both(spark, sf_dir), _EQUAL, TOP, "linear")


@query(f"WITH {_BM25}, {_JACCARD}, {_HITS}, {_fused('0.7 / (60 + rank) + 0.3 * scaled')} SELECT * FROM fused")
def weighted_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_both(spark, sf_dir), _EQUAL, TOP, "weighted_rrf")


@query(
    f"""WITH {_BM25}, {_JACCARD}, {_HITS}
SELECT query_id, sum(n)::BIGINT AS total, count(*) AS fused, sum((c = 2)::BIGINT)::BIGINT AS consensus, sum((c = 1)::BIGINT)::BIGINT AS unique_hits
FROM (SELECT query_id, key, count(*) AS n, count(DISTINCT channel) AS c FROM hits GROUP BY ALL) GROUP BY query_id"""
)
def fusion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fusion_statistics(_both(spark, sf_dir))


_TWICE = ", ".join((_BM25_AT.replace("{0}", "20"), _JACCARD_AT.replace("{0}", "20"), _HITS, _fused("1 / (60 + rank)", 20)))


@query(
    f"""WITH {_TWICE}, cut AS (SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, score, n_channels, lang, source
  FROM fused JOIN documents ON key = doc_id WHERE n_chars >= 200) WHERE rank <= 10),
best AS (SELECT query_id, max(score) AS best FROM cut GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN best IS NULL THEN 'retrieval' WHEN best < 0.012 THEN 'quality_gate' ELSE 'pass' END AS stage, key, rank, score, n_channels, lang, source
FROM benchmark LEFT JOIN best ON best.query_id = item_id LEFT JOIN cut ON cut.query_id = item_id"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels at twice the cut, fused, filtered by metadata, cut and gated."""
    docs = table(spark, sf_dir, "documents")
    out = retrieval.hybrid_search(docs, _asked(spark, sf_dir), TOP, {"n_chars": {"$gte": 200}}, threshold=0.012)
    return out.select("query_id", "stage", "key", "rank", "score", "n_channels", "lang", "source")


def _by_length(query: str, texts: list[str]) -> list[float]:
    """Stands in for a reranking model; it fails for some queries, as a service may."""
    if len(query) % 7 == 0:
        raise ConnectionError("no answer")
    return [min(1.0, len(t) / 5000) for t in texts]


@query(
    f"""WITH {_TWICE}, cand AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, score, n_channels,
  CASE WHEN length(q.text) % 7 <> 0 THEN least(1.0::DOUBLE, length(coalesce(d.text, '')) / 5000) END AS rerank_score
  FROM fused JOIN documents AS d ON key = doc_id JOIN benchmark AS q ON query_id = item_id WHERE n_chars >= 200),
cut AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, place) AS rank, score, n_channels, rerank_score FROM cand QUALIFY rank <= 10),
best AS (SELECT query_id, max(coalesce(rerank_score, score)) AS best FROM cut GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN best IS NULL THEN 'retrieval' WHEN best < 0.5 THEN 'quality_gate' ELSE 'pass' END AS stage, key, rank, score, rerank_score,
  CASE WHEN rerank_score >= 0.8 THEN 'high' WHEN rerank_score >= 0.5 THEN 'medium' WHEN rerank_score IS NOT NULL THEN 'low' END AS level
FROM benchmark LEFT JOIN best ON best.query_id = item_id LEFT JOIN cut ON cut.query_id = item_id"""
)
def hybrid_search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search whose hits a given function ranks again before they are cut; the gate looks at its scores."""
    docs = table(spark, sf_dir, "documents")
    out = retrieval.hybrid_search(docs, _asked(spark, sf_dir), TOP, {"n_chars": {"$gte": 200}}, threshold=0.5, scorer=_by_length)
    return out.select("query_id", "stage", "key", "rank", "score", "rerank_score", "level")


_FIRST = ", ".join((_BM25_AT.replace("{0}", "20").replace("FROM documents", "FROM documents WHERE lang = 'en'"), _JACCARD_AT.replace("{0}", "20").replace("FROM documents", "FROM documents WHERE lang = 'en'"), _HITS, _fused("0.7 / (60 + rank) + 0.3 * scaled", 20)))


@query(f"WITH {_FIRST} SELECT query_id, key, rank, score, n_channels FROM fused WHERE rank <= 10")
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter before both searches, fused by ranks and scores."""
    out = retrieval.hybrid_search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), TOP, {"lang": "en"}, filter_first=True, method="weighted_rrf")
    return out.where("key is not null").select("query_id", "key", "rank", "score", "n_channels")


@query(
    f"""WITH {_JACCARD}
SELECT b.item_id AS query_id, CASE WHEN best IS NULL THEN 'retrieval' WHEN best < 0.35 THEN 'quality_gate' ELSE 'pass' END AS stage, coalesce(n, 0) AS n_hits, best
FROM benchmark AS b LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM ja GROUP BY 1) ON query_id = item_id"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.quality_gate(jaccard_search(spark, sf_dir), _asked(spark, sf_dir), 0.35)


#: Languages are the pools.
POOLS = ["en", "de", "fr", "es"]
POOL_WEIGHTS = {"en": 0.5, "de": 2.0}
_POOLED = f"""{_JACCARD},
po_d AS (SELECT doc_id AS key, lang AS pool, list_position({POOLS}, lang) AS place, coalesce(text, '') AS body FROM documents),
po AS (SELECT query_id, key, pool, place, body, row_number() OVER (PARTITION BY query_id, pool ORDER BY score DESC, key) AS rank, round(score, 6) AS score
  FROM ja_s JOIN po_d USING (key) WHERE place IS NOT NULL QUALIFY rank <= {TOP})"""


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each pool's own search."""
    asked = _asked(spark, sf_dir)
    return retrieval.in_pools(table(spark, sf_dir, "documents"), POOLS, lambda docs: retrieval.jaccard_search(docs, asked, TOP), "lang")


@query(
    f"""WITH {_POOLED}, w AS (SELECT query_id, pool, place, key, body, round(score * CASE pool {" ".join(f"WHEN '{p}' THEN {x}::DOUBLE" for p, x in POOL_WEIGHTS.items())} ELSE 1.0 END, 10) AS score FROM po),
o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, body ORDER BY score DESC, place, key) = 1)
SELECT query_id, pool, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, round(score, 6) AS score FROM o QUALIFY rank <= 5"""
)
def pool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pool_search(_pooled(spark, sf_dir), table(spark, sf_dir, "documents"), POOL_WEIGHTS, 5)


@query(
    f"""WITH {_POOLED}, s AS (SELECT * FROM po WHERE pool <> 'en' OR rank <= 5),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, body ORDER BY pool <> 'en', place, rank, key) = 1)
SELECT query_id, pool, key, rank, score FROM o QUALIFY pool = 'en' OR row_number() OVER (PARTITION BY query_id, pool ORDER BY rank, key) <= 3"""
)
def cross_pool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cross_pool(_pooled(spark, sf_dir), table(spark, sf_dir, "documents"), "en", 5)


#: Of documents by their rest modulo 7: 3 is removed, 5 is replaced by its text twice over with a word before it.
_KEPT = "FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN 'replaced ' || text || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query(f"WITH {_BM25.replace('FROM documents', _KEPT)} SELECT * FROM bm")
def text_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of a stored index after documents were added, replaced and removed, and segments compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = text_index.TextIndex(spark, new_path(spark, "text-index"))
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1"))
    index.remove(docs.where("doc_id % 7 = 3"))
    index.compact()
    index.add(docs.where("doc_id % 7 = 5").withColumn("text", F.concat(F.lit("replaced "), "text", F.lit(" "), "text")))
    return index.search(_asked(spark, sf_dir), TOP)


# Words of the benchmark that are long enough to be names, with the number of their first item as their place.
@query(
    r"""WITH w AS (SELECT word, min(item_id) AS place FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM benchmark) GROUP BY word),
m AS (SELECT doc_id, word, place FROM documents JOIN w ON contains(text, word)),
g AS (SELECT doc_id, count(*) AS n_words, min(place) AS first_place, arg_min(word, (-length(word), word)) AS longest FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::INT AS n_words, first_place::VARCHAR AS first_place, longest FROM documents LEFT JOIN g USING (doc_id)"""
)
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of a large dictionary stand in each document: how many, the first declared and the longest."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("word"))
    words = words.groupBy("word").agg(F.min("item_id").alias("place"))
    by_place, by_word = matching.matcher(words.withColumn("value", F.col("place"))), matching.matcher(words.withColumn("value", F.col("word")))
    rows = table(spark, sf_dir, "documents").select("doc_id", by_place(F.col("text")).alias("places"), by_word(F.col("text")).alias("words"))
    return rows.select("doc_id", F.size("words").alias("n_words"), matching.first_declared(F.col("places")).alias("first_place"), matching.longest(F.col("words")).alias("longest"))


@query(
    f"""WITH {_COSINE}, g AS (SELECT query_id, label AS key, min(rank) AS best FROM co JOIN embeddings ON key = vec_id GROUP BY ALL)
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY best, key) AS rank FROM g"""
)
def dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits deduplicated by the label that they share."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return retrieval.dedupe_ranked(cosine_search(spark, sf_dir).join(labels, "key"), F.col("label"))


@query()
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hits fill a context of 2000 characters; a fold, tested against a loop."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return chunking.build_context(docs.join(found_few(jaccard_search(spark, sf_dir)), "key"), 2000, 10)


@query()
def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each context is and what it leaves out; of ``context_build``, tested with it."""
    return chunking.context_report(context_build(spark, sf_dir), 2000)


_ROUND = "SELECT query_id, trim(text) AS text, max(score) AS score FROM {0} JOIN documents ON doc_id = key WHERE score >= 0.05 AND trim(text) <> '' GROUP BY 1, 2"
_AGAIN = _JACCARD.replace("ja_", "jb_").replace("ja AS", "jb AS").replace("FROM benchmark", "FROM rd_q")


@query(
    f"""WITH {_JACCARD}, rd_1 AS ({_ROUND.format("ja")}),
rd_q AS (SELECT query_id AS item_id, q AS text FROM (SELECT query_id, trim(substr(arg_min(text, (-score, text)), 1, 200)) AS q FROM rd_1 GROUP BY 1) JOIN benchmark ON item_id = query_id WHERE q <> '' AND q <> trim(benchmark.text)),
{_AGAIN}, rd_2 AS ({_ROUND.format("jb")})
SELECT query_id, 1::INT AS "round", md5(text) AS text_md5, score FROM rd_1
UNION ALL SELECT query_id, 2::INT, md5(text), score FROM rd_2 ANTI JOIN rd_1 USING (query_id, text)"""
)
def retrieval_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over all documents; the begin of the best new text asks the second."""
    docs = table(spark, sf_dir, "documents")

    def search(asked: DataFrame) -> DataFrame:
        hits = retrieval.jaccard_search(docs, asked, TOP)
        return docs.select(F.col("doc_id").alias("key"), "text").join(found_few(hits), "key").select("query_id", "text", F.col("key").cast("string").alias("source"), "score")

    found, _, _ = rounds.searched_in_rounds(_asked(spark, sf_dir), search, lambda q, text, source: F.substring(text, 1, 200), 2, 0.05)
    return found.select("query_id", "round", F.md5("text").alias("text_md5"), "score")
