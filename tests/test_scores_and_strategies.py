"""Scores of texts and chunks, chunk strategies, completeness and dictionaries on small cases."""

import statistics

import pytest
from pyspark.sql import functions as F

from marlstone.functions import extraction
from marlstone.operators import chunking, knowledge, scorecard

LONG = "第一段说明公司业务的发展情况和未来的计划以及目标。\n\n" * 3


def test_text_scores_equal_a_loop(spark):
    texts = [LONG, "short", None, "", "x" * 60, "中文" * 3000]
    got = scorecard.text_scores(spark.createDataFrame([(t,) for t in texts], "text string")).first()
    n = [len(t or "") for t in texts]
    share = [sum("一" <= c <= "鿿" for c in t or "") / max(len(t or ""), 1) for t in texts]
    paras = [sum(len(p.strip()) > 20 for p in (t or "").split("\n\n")) for t in texts]
    mean = [sum(x) / 6 for x in (n, share, paras)]
    content = min(1.0, mean[1] / 0.3 * 0.5 + min(mean[2] / 5, 1) * 0.5)
    assert (got.doc_count, got.empty_docs) == (6, 3)
    assert [got.avg_length, got.script_ratio, got.avg_paragraphs] == pytest.approx(mean)
    assert got.score == pytest.approx(content * 0.4 + 0.3 + 0.5 * 0.3)
    assert mean[2] < 1 and got.warnings == ["short texts", "few paragraphs"]
    assert got.grade == ("B" if got.score >= 0.75 else "C") and got.score >= 0.6


def test_chunk_scores_equal_a_loop(spark):
    texts = ["完整的句子。", "cut off", "x" * 800 + ".", "line\n", None]
    got = scorecard.chunk_scores(spark.createDataFrame([(t,) for t in texts], "text string")).first()
    n = [len(t or "") for t in texts]
    even = max(0.0, 1 - statistics.pstdev(n) / (sum(n) / 5) * 0.8)
    assert (got.chunk_count, got.min_size, got.max_size) == (5, 0, 801)
    assert [got.std_dev, got.uniformity, got.boundary_quality, got.small_chunk_ratio, got.oversized_ratio] == pytest.approx([statistics.pstdev(n), even, 0.6, 0.8, 0.2])
    assert got.score == pytest.approx(even * 0.35 + 0.6 * 0.35) and got.warnings == ["many small chunks", "oversized chunks"]


def test_scores_of_nothing(spark):
    nothing = spark.createDataFrame([], "lang string, text string")
    for made, count, warning in ((scorecard.text_scores, "doc_count", "no documents"), (scorecard.chunk_scores, "chunk_count", "no chunks")):
        row = made(nothing).first()
        assert (row[count], row.score, row.grade) == (0, 0.0, "F") and warning in row.warnings
        assert made(nothing, ["lang"]).count() == 0


def test_strategies_and_sources(spark):
    text = "句子一二三四五六七八九十。" * 300
    docs = spark.createDataFrame([(1, text), (2, " "), (3, None)], "doc_id int, text string")
    most = {name: [r.n for r in chunking.chunked(docs, name).select(F.length("text").alias("n")).collect()] for name in ("default", "paragraph", "none", "other")}
    assert most["none"] == [len(text)] and most["other"] == most["default"]
    assert 500 < max(most["default"]) <= 550 and 1500 < max(most["paragraph"]) <= 1600
    rows = [(1, "u", "t", "news", text), (2, "", "t", "research", text), (3, None, "", None, text), (4, "v", "t", "news", " ")]
    typed = chunking.chunked_by_type(spark.createDataFrame(rows, "doc_id int, url string, title string, doc_type string, text string"))
    got = {(r.source_id, r.doc_type): r.n for r in typed.groupBy("source_id", "doc_type").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {("u", "news"), ("t", "research"), ("doc_3", "other")} and got["u", "news"] == got["doc_3", "other"] > got["t", "research"]
    assert typed.where("chunk_id = 0 and chunk_start <> 0").count() == 0


def test_metadata_completeness(spark):
    rows = [("s", 0, {"company": "c", "date": "", "currency": "CNY"}), ("", 9, None)]
    docs = spark.createDataFrame(rows, "source string, text_length int, meta map<string,string>")
    assert [r.c for r in docs.select(extraction.metadata_completeness(docs).alias("c")).collect()] == pytest.approx([round(3 / 7, 4), round(1 / 7, 4)])
    assert docs.drop("meta").select(extraction.metadata_completeness(docs.drop("meta")).alias("c")).first().c == pytest.approx(round(1 / 7, 4))


def test_dictionary_with_words_added(spark):
    kind = "term string, value string, kind string"
    words = knowledge.with_terms(spark.createDataFrame([("a", "x", "k"), ("b", "x", "k"), ("a", "z", "other")], kind), spark.createDataFrame([("a", "new", "k"), ("c", "x", "k")], kind))
    assert {(r.term, r.kind): r.value for r in words.collect()} == {("a", "k"): "new", ("b", "k"): "x", ("c", "k"): "x", ("a", "other"): "z"}
    assert {(r.kind, r.n_terms, r.n_values) for r in knowledge.dictionary_statistics(words).collect()} == {("k", 3, 2), ("other", 1, 1)}
