"""Information-retrieval metrics and answer verification by deterministic rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per judged query: recall@k, precision@k, MRR, NDCG@k and MAP@k.

    hits (query_id, key, rank), qrels (query_id, key, grade). Only grades over 0
    are relevant. Precision divides by k even if fewer hits came; MRR has no
    cut; gains are 2^grade - 1; MAP divides by min(relevant, k). Queries
    without relevant rows are left out, queries without hits score 0.
    """
    relevant = qrels.where("grade > 0")
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "key")
    ideal = relevant.withColumn("i", F.row_number().over(ideal_order))
    gain = lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 1)
    totals = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias("idcg"))
    found = hits.select("query_id", "key", "rank").join(relevant, ["query_id", "key"])
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    inside = F.col("rank") <= k
    sums = found.groupBy("query_id").agg(
        F.sum(inside.cast("long")).alias("n_found"),
        F.min("rank").alias("first"),
        F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.sum(F.when(inside, F.col("nth") / F.col("rank"))).alias("precisions"),
    )
    return _metrics(totals.join(sums, "query_id", "left"), k)


def _metrics(rows: DataFrame, k: int) -> DataFrame:
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "query_id",
        zero(F.col("n_found") / F.col("n_rel")).alias("recall"),
        zero(F.col("n_found") / k).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(F.col("precisions") / F.least("n_rel", F.lit(k))).alias("map"),
    )


def group_metrics(hits: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``ranking_metrics`` where all other members of a query's group are relevant, with grade 1.

    members (key, group), each key once; queries (query_id, group) of unique ids.
    Groups are counted and hits looked up, so no pairs of query and member are
    made. A query that is a member itself is not relevant to itself.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    own = members.select(F.col("key").alias("query_id"), "group").withColumn("own", F.lit(1))
    totals = queries.join(sizes, "group").join(own, ["query_id", "group"], "left")
    totals = totals.select("query_id", "group", (F.col("size") - F.coalesce("own", F.lit(0))).alias("n_rel")).where("n_rel > 0")
    ideal = F.element_at(F.array(*(F.lit(sum(1 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1))), F.least("n_rel", F.lit(k)).cast("int"))
    asked = hits.select("query_id", "key", "rank").join(totals.select("query_id", "group"), "query_id").where("query_id <> key")
    found = asked.join(members, ["key", "group"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    inside = F.col("rank") <= k
    sums = found.groupBy("query_id").agg(
        F.sum(inside.cast("long")).alias("n_found"),
        F.min("rank").alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.when(inside, F.col("nth") / F.col("rank"))).alias("precisions"),
    )
    return _metrics(totals.withColumn("idcg", ideal).join(sums, "query_id", "left"), k)


METRICS = ("recall", "precision", "mrr", "ndcg", "map")


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over queries, per values of ``by`` (channel, tag and so on), with their number; an array counts for each of its values."""
    for name in by:
        if dict(metrics.dtypes)[name].startswith("array"):
            metrics = metrics.withColumn(name, F.explode(name))
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m), 5).alias(m) for m in METRICS))


def compare_to_baseline(now: DataFrame, base: DataFrame, keys: list[str], tolerance: float = 0.02, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(keys, baseline, value, verdict) of metrics in both: better, worse or same within the tolerance."""
    rows = now.select(*keys, "metric", "value").join(base.select(*keys, "metric", F.col("value").alias("baseline")), [*keys, "metric"])
    sign = F.when(F.col("metric").isin(list(lower_is_better)), -1).otherwise(1)
    gain = sign * (F.col("value") - F.col("baseline"))
    return rows.withColumn("verdict", F.when(gain > tolerance, "better").when(gain < -tolerance, "worse").otherwise("same"))


def gate_evaluation(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row (n_cases, accuracy, false_block_rate, false_pass_rate, diagnostics_complete, n_known_limits).

    cases (case_id, expected ``pass`` or ``block``, expected_stage or null,
    known_limit), outcomes (case_id, blocked, stage). A blocked case is right
    only at the stage that is expected, if one is. A block without a stage is an
    incomplete diagnosis. Cases of a known limit are counted, not judged. Rates
    without cases are 0.
    """
    rows = cases.join(outcomes, "case_id")
    want = F.col("expected") == "block"
    right = (F.col("blocked") == want) & (~F.col("blocked") | F.col("expected_stage").isNull() | F.col("stage").eqNullSafe(F.col("expected_stage")))
    told = ~F.col("blocked") | F.col("stage").isNotNull()
    judged = ~F.coalesce("known_limit", F.lit(False))
    count = lambda c: F.sum(F.when(judged & c, 1).otherwise(0))
    rate = lambda part, whole: F.round(F.coalesce(count(part) / F.nullif(count(whole), F.lit(0)), F.lit(0.0)), 6)
    every = F.lit(True)
    return rows.agg(
        F.coalesce(count(every), F.lit(0)).cast("long").alias("n_cases"),
        rate(right, every).alias("accuracy"),
        rate(~want & F.col("blocked"), ~want).alias("false_block_rate"),
        rate(want & ~F.col("blocked"), want).alias("false_pass_rate"),
        rate(told, every).alias("diagnostics_complete"),
        F.coalesce(F.sum(F.when(judged, 0).otherwise(1)), F.lit(0)).cast("long").alias("n_known_limits"),
    )


def worst_queries(metrics: DataFrame, n: int = 5, by: str = "recall") -> DataFrame:
    """The ``n`` queries of the least value, in order; equal ones by id."""
    return metrics.orderBy(by, "query_id").limit(n)


# Weights of the four layers, limits, units after numbers, and words that refer to a source.
LAYERS = {"grounding": 0.417, "numbers": 0.25, "citations": 0.167, "structure": 0.167}
GROUNDED_SHARE = 0.3
NUMBER = r"\d+(?:\.\d+)?\s*[%％万亿元美刀港币人民块个台套条家次份月年日季]?"
REFERENCES = ["来源", "引用", "参考", "根据", "数据显示", "据报", "资料", "报告"]
LOOSE_REFERENCES = [*REFERENCES, "新闻", "报道", "分析", "评估", "显示", "表明", "认为"]
SECTIONS = {
    "rag": [r"(?i)(?:^|\n)#+\s*(?:摘要|概述|总结|Summary|Overview)", r"(?i)(?:^|\n)#+\s*(?:要点|关键|发现|Key|Finding)", r"(?i)(?:^|\n)#+\s*(?:分析|Analysis|详情)", r"(?i)(?:^|\n)#+\s*(?:风险|注意|提示|Risk|Warning|Caution)"],
    "analysis": [
        r"(?i)关键信号|核心信号|主要信号|重要信号|Key\s*Signal|signal",
        r"(?i)影响分析|多维影响|行业影响|市场影响|Impact|冲击|波及|利好|利空|受益|受损",
        r"(?i)风险提示|风险因素|不确定因素|注意事项|Risk|Warning|潜在风险|下行风险|风险点",
        r"(?i)后续关注|持续关注|投资建议|投资启示|趋势|展望|Watch|建议关注|下一步|值得关注",
    ],
}


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words of two letters or more, and pairs of neighbouring Chinese characters, without stop words.

    Where a dictionary is at hand, a ``segmenter`` gives better words.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(r"[\p{L}&&[^\x{4E00}-\x{9FFF}]]{2,}|[\x{4E00}-\x{9FFF}]{2,}"), 0)
    pairs = F.transform(found, lambda w: F.when(w.rlike(r"^[\x{4E00}-\x{9FFF}]"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w)))
    return F.array_except(F.array_distinct(F.flatten(pairs)), F.array(*(F.lit(w) for w in stop)))


def sentences(text: Column, min_chars: int = 8, ends: str = r"[。！？.!?\n]") -> Column:
    """Parts between sentence ends with more than ``min_chars`` characters."""
    parts = F.split(F.coalesce(text, F.lit("")), ends, -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > min_chars)


def numbers(text: Column) -> Column:
    """Numbers with their unit, without citation marks; whole numbers without decimals."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]", " ")
    found = F.regexp_extract_all(plain, F.lit(NUMBER), 0)
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"\.0+(?=\D|$)", ""))


def citation_integrity(answer: Column, n_sources: Column, mode: str = "rag") -> Column:
    """0.9 times the share of valid marks, and 0.1 for two or more; without marks by whether words refer to a source."""
    marks = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("long"))
    valid = F.filter(marks, lambda m: m.between(1, n_sources))
    score = F.least(F.lit(1.0), 0.9 * F.size(valid) / F.size(marks) + F.when(F.size(marks) >= 2, 0.1).otherwise(0.0))
    words, high, low = (LOOSE_REFERENCES, 0.8, 0.6) if mode == "analysis" else (REFERENCES, 0.6, 0.2)
    refers = F.coalesce(answer, F.lit("")).rlike("|".join(words))
    return F.when(F.size(marks) > 0, F.round(score, 4)).when(refers, high).otherwise(low)


def structure(answer: Column, patterns: list[str]) -> Column:
    """The share of the patterns found, and 0.2 for two or more of them, at most 1."""
    found = sum((F.coalesce(answer, F.lit("")).rlike(p).cast("int") for p in patterns), F.lit(0))
    return F.round(F.least(F.lit(1.0), found / len(patterns) + F.when(found >= 2, 0.2).otherwise(0.0)), 4)


def overall(layers: dict[str, Column]) -> Column:
    """Weighted mean of the layers given, the weights scaled to one."""
    total = sum(LAYERS[k] for k in layers)
    return F.round(sum((LAYERS[k] * c for k, c in layers.items()), F.lit(0.0)) / total, 4)


def risk(score: Column, unanchored: Column | None = None) -> Column:
    """low from 0.8 with every sentence anchored, medium from 0.6 with two at most that are not, else high."""
    loose = F.lit(0) if unanchored is None else unanchored
    return F.when((score >= 0.8) & (loose == 0), "low").when((score >= 0.6) & (loose <= 2), "medium").otherwise("high")
