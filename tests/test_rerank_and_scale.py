"""Reranking with failing functions, linear averages, group metrics without pairs, the gate by runs."""

import random
import time

from pyspark.sql import functions as F

from marlstone.functions import predicates
from marlstone.operators import evaluation, indicators, rerank, retrieval


def by_digits(query, texts):
    if query == "broken":
        raise RuntimeError("down")
    if query == "short":
        return [0.5]
    if query == "late" and "7" in texts[0]:
        raise ValueError("second batch")
    return [int("".join(c for c in t if c.isdigit()) or 0) / 10 for t in texts]


def test_failed_batches_leave_their_queries_as_they_were(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 10)] + [(50, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "fine"), (2, "broken"), (3, "short"), (4, "late"), (5, "none")], "query_id int, query string")
    hits = spark.createDataFrame([(q, i, i, 1.0 / i) for q in (1, 2, 3, 4) for i in range(1, 10)] + [(1, 50, 10, 0.01), (1, 77, 11, 0.01)], "query_id int, key long, rank int, score double")
    got = {}
    for r in rerank.reranked(hits, queries, docs, by_digits, 5, batch=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], r["rerank_score"], r["level"], r["rank"]))
    assert got[1] == [(9, 0.9, "high", 1), (8, 0.8, "high", 2), (7, 0.7, "medium", 3), (6, 0.6, "medium", 4), (5, 0.5, "medium", 5)]
    for q in (2, 3, 4):
        assert got[q] == [(i, None, None, i) for i in range(1, 6)]
    assert 5 not in got


def test_hybrid_search_reranks_and_gates(spark):
    docs = spark.createDataFrame([(i, f"common word {i}") for i in range(1, 10)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common 3"), (2, "broken"), (3, "zzz")], "query_id int, query string")
    got = retrieval.hybrid_search(docs, queries, 3, threshold=0.75, scorer=by_digits).collect()
    first = sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])
    scores = [r["rerank_score"] for r in first]
    assert len(first) == 3 and scores == sorted(scores, reverse=True) and all(r["rerank_score"] == r["key"] / 10 for r in first)
    assert {r["stage"] for r in first} == {"pass" if scores[0] >= 0.75 else "quality_gate"}
    assert [(r["key"], r["stage"]) for r in got if r["query_id"] == 3] == [(None, "retrieval")]
    plain = retrieval.hybrid_search(docs, queries, 3)
    assert "rerank_score" not in plain.columns


def test_averages_match_a_loop_and_grow_linearly(spark):
    rng = random.Random(1)
    for n in (1, 2, 63, 64, 65, 128, 500):
        values = [rng.uniform(1, 100) for _ in range(n)]
        want = [values[0]]
        for x in values[1:]:
            want.append(want[-1] * (1 - 0.2) + x * 0.2)
        assert spark.createDataFrame([(values,)], "v array<double>").select(indicators._ewm(F.col("v"), 0.2)).first()[0] == want
    assert spark.createDataFrame([([],), (None,)], "v array<double>").select(indicators._ewm(F.col("v"), 0.2).alias("x")).where("size(x) > 0").count() == 0
    took = []
    for n in (20_000, 40_000):
        bars = spark.range(n).select(F.lit("s").alias("symbol"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("date"), (F.sin("id") * 10 + 50).alias("close"))
        start = time.time()
        assert indicators.macd(bars).agg(F.sum("hist")).count() == 1
        assert indicators.macd(bars).agg(F.max("dif")).first()[0] is not None
        took.append(time.time() - start)
    assert took[1] < 3 * took[0] + 2


def test_group_metrics_equal_those_of_pairs(spark):
    rng = random.Random(6)
    members = [(i, rng.randrange(5)) for i in range(60)] + [(99, 77)]
    hits = [(q, key, rank) for q in range(0, 60, 7) for rank, key in enumerate(rng.sample(range(60), 12), 1)]
    asked = [(q, dict(members)[q]) for q in range(0, 60, 7)] + [(99, 77), (1000, 2)]
    pairs = [(q, key, 1) for q, group in asked for key, other in members if other == group and key != q]
    table = spark.createDataFrame(hits, "query_id long, key long, rank int")
    want = evaluation.ranking_metrics(table, spark.createDataFrame(pairs, "query_id long, key long, grade int"), 10)
    got = evaluation.group_metrics(table, spark.createDataFrame(members, "key long, group long"), spark.createDataFrame(asked, "query_id long, group long"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gate_counts_characters_of_the_script(spark):
    texts = ["公司的净利润增长了很多很多很多很多很多很多", "abc 公司 def ghi jkl mno pqr stu", "abcdefghijklmnopqrstuvwx", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0]["reason"] for r in docs.select(predicates.relevance_gate(F.col("t"), ["公司"], min_share=0.05)).collect()]
    assert got == [None, None, "script", "too_short", "too_short"]
