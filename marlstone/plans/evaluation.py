"""Metrics of the vector search, with the label as relevance, and the answer checks on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, guard, outputs, retrieval
from . import search
from .registry import query, table

STOP = ["the", "and", "of", "to", "le", "la", "de", "der", "die"]

_METRICS = f"""{search._COSINE},
rel AS (SELECT q.vec_id AS query_id, d.vec_id AS key, 1 AS grade FROM embeddings AS q JOIN embeddings AS d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
tot AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY key) AS i FROM rel) GROUP BY 1),
fnd AS (SELECT co.query_id, rank, row_number() OVER (PARTITION BY co.query_id ORDER BY rank) AS nth FROM co JOIN rel ON co.query_id = rel.query_id AND co.key = rel.key),
agg AS (SELECT query_id, count(*) AS n_found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank) AS precisions FROM fnd GROUP BY 1),
met AS (SELECT query_id, round(coalesce(n_found / n_rel, 0), 6) AS recall, round(coalesce(n_found / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(precisions / least(n_rel, 10), 0), 6) AS map FROM tot LEFT JOIN agg USING (query_id))
"""


@query(f"WITH {_METRICS} SELECT * FROM met")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    members = vectors.select(F.col("vec_id").alias("key"), F.col("label").alias("group"))
    asked = members.where(F.col("key") % search.EVERY == 0).withColumnRenamed("key", "query_id")
    return evaluation.group_metrics(search.cosine_search(spark, sf_dir), members, asked, 10)


@query(
    f"""WITH {_METRICS} SELECT label, count(*) AS n_queries, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr,
round(avg(ndcg), 5) AS ndcg, round(avg(map), 5) AS map FROM met JOIN embeddings ON query_id = vec_id GROUP BY label"""
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return evaluation.macro(retrieval_metrics(spark, sf_dir).join(labels, "query_id"), "label")


@query(
    """WITH m AS (SELECT lang, unnest(['mean_chars', 'share_long']) AS metric, unnest([avg(n_chars) / 1000, avg((n_chars > 1000)::INT)]) AS value FROM documents GROUP BY lang),
b AS (SELECT unnest(['mean_chars', 'share_long']) AS metric, unnest([avg(n_chars) / 1000, avg((n_chars > 1000)::INT)]) AS baseline FROM documents)
SELECT lang, metric, round(value, 6) AS value, round(baseline, 6) AS baseline,
  CASE WHEN (value - baseline) * (CASE metric WHEN 'mean_chars' THEN -1 ELSE 1 END) > 0.02 THEN 'better'
       WHEN (value - baseline) * (CASE metric WHEN 'mean_chars' THEN -1 ELSE 1 END) < -0.02 THEN 'worse' ELSE 'same' END AS verdict FROM m JOIN b USING (metric)"""
)
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each language against those of all documents, with a direction for each metric."""
    docs = table(spark, sf_dir, "documents")

    def measured(rows):
        wide = rows.agg((F.avg("n_chars") / 1000).alias("a"), F.avg((F.col("n_chars") > 1000).cast("double")).alias("b"))
        return wide.selectExpr("*", "stack(2, 'mean_chars', a, 'share_long', b) AS (metric, value)")

    now = measured(docs.groupBy("lang")).select("lang", "metric", "value")
    base = docs.select("lang").distinct().join(F.broadcast(measured(docs).select("metric", "value")))  # two rows
    out = evaluation.compare_to_baseline(now, base, ["lang"], 0.02, ("mean_chars",))
    return out.select("lang", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "verdict")


_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '\p{{L}}{{2,}}')), lambda w: w NOT IN (%s))" % ", ".join(f"'{w}'" for w in STOP)
_NUMBERS = r"list_transform(regexp_extract_all(regexp_replace({0}, '\[\d+\]', ' ', 'g'), '%s'), lambda x: regexp_replace(regexp_replace(x, '\s+', '', 'g'), '\.0+(\D|$)', '\1'))" % evaluation.NUMBER
#: An answer's sources: the user turns at most this many turns before it.
BACK = 5
STRUCTURE = [r"\n", "(?i)however|und|mais", r"\d", r"\?"]

_GUARD = rf"""
ga AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
gs AS (SELECT a.conv_id, a.turn, q.text FROM ga AS a JOIN conversations AS q ON a.conv_id = q.conv_id AND q.turn BETWEEN a.turn - {BACK} AND a.turn - 1 WHERE q.role = 'user' AND trim(q.text) <> ''),
gc AS (SELECT conv_id, turn, count(*) AS n_sources FROM gs GROUP BY ALL),
gk AS (SELECT conv_id, turn, {_WORDS.format("text")} AS known FROM gs),
ge AS (SELECT conv_id, turn, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[。！？.!?\n]'), lambda x: trim(x)), lambda x: length(x) > 8) AS ss FROM ga)),
gw AS (SELECT conv_id, turn, i, {_WORDS.format("x")} AS w FROM ge),
gb AS (SELECT conv_id, turn, i, any_value(len(w)) AS n, max(CASE WHEN len(w) > 0 THEN len(list_intersect(w, known)) / len(w) END) AS best FROM gw LEFT JOIN gk USING (conv_id, turn) GROUP BY ALL),
g1 AS (SELECT conv_id, turn, count(*) AS n_sentences, sum((n < 2 OR coalesce(best, 0) >= 0.3)::BIGINT)::BIGINT AS n_anchored FROM gb GROUP BY ALL),
gn AS (SELECT conv_id, turn, unnest({_NUMBERS.format("answer")}) AS x FROM ga),
gm AS (SELECT DISTINCT conv_id, turn, x, true AS known FROM (SELECT conv_id, turn, unnest({_NUMBERS.format("text")}) AS x FROM gs)),
g2 AS (SELECT conv_id, turn, count(*) AS n_numbers, count(known) AS n_verified FROM gn LEFT JOIN gm USING (conv_id, turn, x) GROUP BY ALL),
gr AS (SELECT ga.*, coalesce(n_sources, 0) AS n_sources, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_anchored, 0) AS n_anchored,
  round(coalesce(n_anchored / n_sentences, 1.0), 4)::DOUBLE AS grounding, round(coalesce(n_verified / n_numbers, 1.0), 4)::DOUBLE AS numbers,
  list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: try_cast(x AS BIGINT)) AS marks, trim(answer) = '' AS blank,
  {" + ".join(f"regexp_matches(answer, '{x}')::INT" for x in STRUCTURE)} AS found
  FROM ga LEFT JOIN gc USING (conv_id, turn) LEFT JOIN g1 USING (conv_id, turn) LEFT JOIN g2 USING (conv_id, turn)),
gl AS (SELECT *, CASE WHEN blank THEN 'empty_answer' WHEN n_sources = 0 THEN 'no_sources' END AS skip_reason, n_sentences - n_anchored AS n_unanchored,
  CASE WHEN len(marks) > 0 THEN round(least(1.0, 0.9 * len(list_filter(marks, lambda m: m BETWEEN 1 AND n_sources)) / len(marks) + CASE WHEN len(marks) >= 2 THEN 0.1 ELSE 0 END), 4)
    WHEN regexp_matches(answer, '{"|".join(evaluation.REFERENCES)}') THEN 0.6 ELSE 0.2 END::DOUBLE AS citations,
  round(least(1.0, found / {len(STRUCTURE)} + CASE WHEN found >= 2 THEN 0.2 ELSE 0 END), 4)::DOUBLE AS structure FROM gr),
go AS (SELECT *, round((0.417::DOUBLE * grounding + 0.25::DOUBLE * numbers + 0.167::DOUBLE * citations + 0.167::DOUBLE * structure) / 1.001::DOUBLE, 4) AS overall FROM gl)
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    # A user turn is a source of the answers that follow within BACK turns.
    sources = turns.where("role = 'user'").select("conv_id", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + BACK)).alias("turn"), "text")
    return guard.check(answers, sources, ["conv_id", "turn"], STOP, patterns=STRUCTURE)


@query(
    f"""WITH {_GUARD} SELECT conv_id, turn, skip_reason, n_sources, n_unanchored::INT AS n_unanchored,
CASE WHEN skip_reason IS NULL THEN grounding END AS grounding, CASE WHEN skip_reason IS NULL THEN numbers END AS numbers, CASE WHEN skip_reason IS NULL THEN citations END AS citations,
CASE WHEN skip_reason IS NULL THEN structure END AS structure, CASE WHEN skip_reason IS NULL THEN overall END AS overall,
CASE WHEN skip_reason IS NOT NULL THEN 'unknown' WHEN overall >= 0.8 AND n_unanchored = 0 THEN 'low' WHEN overall >= 0.6 AND n_unanchored <= 2 THEN 'medium' ELSE 'high' END AS risk,
CASE WHEN skip_reason IS NOT NULL THEN NULL WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.65 THEN 'C' WHEN overall >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM go"""
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers for each answer against the user turns shortly before it; without any it is skipped."""
    rows = _checked(spark, sf_dir)
    return rows.select("conv_id", "turn", "skip_reason", "n_sources", "n_unanchored", *evaluation.LAYERS, "overall", "risk", "grade")


@query(
    f"""WITH {_GUARD} SELECT conv_id, turn, CASE WHEN skip_reason IS NULL THEN round(0.6::DOUBLE * grounding + 0.4::DOUBLE * numbers, 4) END AS quick_score,
coalesce(skip_reason IS NULL AND round(0.6::DOUBLE * grounding + 0.4::DOUBLE * numbers, 4) < 0.5, false) AS warning FROM go"""
)
def answer_prechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.precheck(_checked(spark, sf_dir)).select("conv_id", "turn", "quick_score", "warning")


@query(
    f"""WITH {_GUARD} SELECT turn, count(*) AS n, sum((skip_reason IS NOT NULL)::BIGINT)::BIGINT AS skipped, round(avg(overall) FILTER (skip_reason IS NULL), 8) AS mean_overall,
round(quantile_cont(overall, 0.5) FILTER (skip_reason IS NULL), 8) AS median FROM go GROUP BY turn"""
)
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.col("skipped").cast("long")).alias("skipped"), F.round(F.avg("overall"), 8).alias("mean_overall"), F.round(F.expr("percentile(overall, 0.5)"), 8).alias("median"))


FIELDS = {"opening": r"^([^\n]+)\n", "number": r"(\d+)", "question": r"([^.?!\n]+)\?", "list": r"\n[-*] ([^\n]+)"}
_OUTPUT = f"""{_GUARD},
ou AS (SELECT conv_id, turn, grounding, numbers, length(answer) AS n_chars, list_filter([{", ".join(f"CASE WHEN trim(regexp_extract(answer, '{p}', 1)) = '' THEN '{n}' END" for n, p in FIELDS.items())}], lambda x: x IS NOT NULL) AS missing
  FROM go WHERE skip_reason IS NULL),
oq AS (SELECT *, round(({len(FIELDS)} - len(missing)) / {len(FIELDS)}, 4)::DOUBLE AS completeness,
  round(0.4::DOUBLE * numbers + 0.3::DOUBLE * grounding + 0.3::DOUBLE * round(({len(FIELDS)} - len(missing)) / {len(FIELDS)}, 4), 4) AS output_quality,
  CASE WHEN n_chars > 600 THEN 'good' ELSE 'bad' END AS tier FROM ou)
"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    rows = _checked(spark, sf_dir).where("not skipped").join(texts, ["conv_id", "turn"])
    filled = outputs.filled_fields(F.col("text"), FIELDS)
    rows = rows.select("conv_id", "turn", "grounding", "numbers", F.length("text").alias("n_chars"), filled.alias("f"))
    rows = rows.select("*", F.col("f.score").alias("completeness"), F.col("f.missing").alias("missing"))
    quality = outputs.output_quality(F.col("numbers"), F.col("grounding"), F.col("completeness"))
    return rows.withColumn("output_quality", quality).withColumn("tier", F.when(F.col("n_chars") > 600, "good").otherwise("bad"))


@query(f"WITH {_OUTPUT} SELECT conv_id, turn, completeness, missing, output_quality FROM oq")
def output_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields of a template, and quality of numbers, grounding and fields together."""
    return _outputs(spark, sf_dir).select("conv_id", "turn", "completeness", "missing", "output_quality")


@query(f"WITH {_OUTPUT} SELECT tier, count(*) AS n_cases, round(avg(grounding), 6) AS grounding, round(avg(completeness), 6) AS completeness, round(avg(output_quality), 6) AS output_quality FROM oq GROUP BY tier")
def output_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.tier_means(_outputs(spark, sf_dir), ["grounding", "completeness", "output_quality"])


@query(
    f"""WITH {_OUTPUT}, m AS (SELECT count(*) FILTER (tier = 'good') AS n_good, count(*) FILTER (tier = 'bad') AS n_bad, coalesce(avg(output_quality) FILTER (tier = 'good'), 0) AS g,
coalesce(avg(output_quality) FILTER (tier = 'bad'), 0) AS b FROM oq) SELECT n_good, n_bad, round(g, 6) AS good_mean, round(b, 6) AS bad_mean, round(g - b, 6) AS gap FROM m"""
)
def output_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.separation(_outputs(spark, sf_dir))


@query(
    f"""WITH {search._JACCARD}, b AS (SELECT query_id, max(score) AS best FROM ja GROUP BY 1),
c AS (SELECT item_id, CASE WHEN length(text) > 150 THEN 'block' ELSE 'pass' END AS expected, CASE WHEN best IS NULL THEN 'retrieval' WHEN best < 0.35 THEN 'quality_gate' END AS stage FROM benchmark LEFT JOIN b ON query_id = item_id)
SELECT count(*) AS n_cases, round(avg(((stage IS NOT NULL) = (expected = 'block') AND (stage IS NULL OR stage = 'quality_gate'))::INT), 6) AS accuracy,
  round(coalesce(sum((expected = 'pass' AND stage IS NOT NULL)::INT) / nullif(sum((expected = 'pass')::INT), 0), 0), 6) AS false_block_rate,
  round(coalesce(sum((expected = 'block' AND stage IS NULL)::INT) / nullif(sum((expected = 'block')::INT), 0), 0), 6) AS false_pass_rate, 1.0::DOUBLE AS diagnostics_complete, 0::BIGINT AS n_known_limits FROM c"""
)
def gate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality gate held against what was expected of it: here that long queries are blocked."""
    items = table(spark, sf_dir, "benchmark")
    cases = items.select(F.col("item_id").alias("case_id"), F.when(F.length("text") > 150, "block").otherwise("pass").alias("expected"), F.lit("quality_gate").alias("expected_stage"), F.lit(False).alias("known_limit"))
    gate = retrieval.quality_gate(search.jaccard_search(spark, sf_dir), items.select(F.col("item_id").alias("query_id")), 0.35)
    blocked = F.col("stage") != "pass"
    return evaluation.gate_evaluation(cases, gate.select(F.col("query_id").alias("case_id"), blocked.alias("blocked"), F.when(blocked, F.col("stage")).alias("stage")))


@query(f"WITH {_METRICS} SELECT query_id, recall, mrr FROM met ORDER BY recall, query_id LIMIT 5")
def worst_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst_queries(retrieval_metrics(spark, sf_dir), 5).select("query_id", "recall", "mrr")
