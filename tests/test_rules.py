"""Guard, output evaluation, slots, conversations, evidence, vectors and score cards on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import slots
from marlstone.operators import dialogue, evaluation, evidence, guard, knowledge, outputs, scorecard, vectors

STOP = ["the"]


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def checked(spark):
    answers = spark.createDataFrame(
        [
            (1, "# Summary\nRevenue grew to 50.0亿元 in spring. [1][2]\n# Key finding\nNobody knows anything about dragons here."),
            (2, "   "),
            (3, "Some answer without any source at all."),
            (4, "short"),
            (5, "根据报告，增长 20% 是事实。[9]"),
        ],
        "id int, answer string",
    )
    sources = spark.createDataFrame([(1, "In spring the revenue grew"), (1, "It was 50亿元"), (3, "  "), (4, "unrelated"), (5, "增长 20%")], "id int, text string")
    return {r.id: r for r in guard.precheck(guard.check(answers, sources, ["id"], STOP)).collect()}, guard.check(answers, sources, ["id"], STOP)


def test_guard_takes_the_best_source(checked):
    one = checked[0][1]
    # The full stop of 50.0 ends a sentence too; headings of one word are anchored.
    assert (one.n_sources, one.n_sentences, one.n_anchored) == (2, 5, 3)
    assert one.numbers == 1.0 and one.unmatched == [] and one.citations == 1.0 and one.structure == 0.7
    assert one.n_unanchored == len(one.unanchored) and "dragons" in one.unanchored[-1]


def test_guard_skips_explicitly(checked):
    rows = checked[0]
    assert (rows[2].skip_reason, rows[3].skip_reason) == ("empty_answer", "no_sources")
    assert rows[3].overall is None and rows[3].risk == "unknown" and not rows[3].passed and rows[3].grade is None and not rows[3].warning
    assert rows[4].grounding == 1.0 and rows[4].numbers == 1.0 and rows[4].citations == 0.2
    assert rows[5].citations == 0.0 and rows[5].numbers == 1.0


def test_guard_texts(checked):
    rows = {r.id: r for r in checked[1].select("id", guard.serialised().alias("j"), guard.report_text().alias("t")).collect()}
    one = json.loads(rows[1].j)
    assert one["layers"]["numbers"] == {"score": 1.0, "verified": 1, "total": 1, "unmatched": []} and not one["skipped"]
    skipped = json.loads(rows[3].j)
    assert skipped["skip_reason"] == "no_sources" and "layers" not in skipped and rows[3].t == ""
    assert rows[1].t.startswith("Quality: ") and "no source: " in rows[1].t


def test_modes_and_bands(spark):
    got = values(spark, evaluation.citation_integrity(F.lit("数据表明"), F.lit(1), "analysis"), evaluation.citation_integrity(F.lit("x"), F.lit(1), "analysis"), evaluation.structure(F.lit("利好与风险点"), evaluation.SECTIONS["analysis"]))
    assert list(got) == [0.8, 0.6, 0.7]
    risks = values(spark, evaluation.risk(F.lit(0.9), F.lit(1)), evaluation.risk(F.lit(0.9), F.lit(0)), evaluation.risk(F.lit(0.7), F.lit(3)))
    assert list(risks) == ["medium", "low", "high"]
    assert values(spark, evaluation.numbers(F.lit("[1] 3.0 % 与 2.50亿, 7"))).asDict().popitem()[1] == ["3%", "2.50亿", "7"]


def test_gate_evaluation(spark):
    cases = spark.createDataFrame([(1, "pass", None, False), (2, "block", "quality_gate", False), (3, "block", "quality_gate", False), (4, "pass", None, False), (5, "block", None, True)], "case_id int, expected string, expected_stage string, known_limit boolean")
    seen = spark.createDataFrame([(1, False, None), (2, True, "quality_gate"), (3, True, "retrieval"), (4, True, None), (5, False, None)], "case_id int, blocked boolean, stage string")
    assert tuple(evaluation.gate_evaluation(cases, seen).first()) == (4, 0.5, 0.5, 0.0, 0.75, 1)


def test_templates(spark):
    brief = "## 📰 标题\n**时间**: 2024 | **影响**: 高\n**涉及**: （涉及暂缺）\n**行业**: AI\n**市场**:  \n"
    got = values(spark, outputs.filled_fields(F.lit(brief), outputs.TEMPLATES["news_brief"]).alias("f"), outputs.claims(F.lit(brief), outputs.TEMPLATES["news_brief"]).alias("c"))
    assert got.f.filled == 4 and got.f.missing == ["key_players", "market_reaction", "outlook"] and got.c == ["标题", "2024", "高", "AI"]
    deep = "### 摘要\n很好\n行二\n### 成长性\n快"
    got = values(spark, outputs.filled_fields(F.lit(deep), outputs.TEMPLATES["deep_analysis"]).alias("f")).f
    assert got.filled == 2 and "executive_summary" not in got.missing


def test_tiers_floors_and_calibration(spark):
    rows = [("a", "good", [], 1.0), ("b", "good", [], 0.8), ("c", "bad", ["fabricated_number"], 0.5), ("d", "bad", ["ungrounded_claim"], 1.0), ("e", "bad", ["missing_field"], 0.9)]
    cases = spark.createDataFrame(rows, "case_id string, tier string, tags array<string>, score double")
    assert tuple(outputs.separation(cases, "score").first()) == (2, 3, 0.9, 0.8, 0.1)
    assert {r.tags: r.score for r in outputs.tier_means(cases, ["score"], "tags").collect()} == {"fabricated_number": 0.5, "ungrounded_claim": 1.0, "missing_field": 0.9}
    floors = spark.createDataFrame([("a", 0.9), ("b", 0.85), ("gone", 0.1)], "case_id string, floor double")
    assert sorted(r.case_id for r in outputs.floor_breaks(cases, floors, "score").collect()) == ["b", "gone"]
    got = outputs.calibration(cases, ["fabricated_number", "ungrounded_claim"], ["missing_field"]).first()
    assert (got.gap, got.detection_rate, got.gap_ok, got.detection_ok, got.fabricated_ok, got.orthogonal_mean) == (0.15, 0.5, True, False, True, 0.9)
    assert outputs.calibration(cases.limit(0), ["x"], ["y"]).first().detection_rate == 0


def test_slots(spark):
    cleaned = values(spark, *(slots.clean_slot(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("好的，综上所述，“增长”", '"x"', "", " 回答：答案是 5 "))))
    assert list(cleaned) == ["增长", "x", "", "5"]
    scored = values(spark, *(slots.slot_score(F.lit(v), F.lit(g), 3, 10).alias(f"s{i}") for i, (v, g) in enumerate((("", "g"), ("无", "g"), ("信息不足啊", "g"), ("ab", "g"), ("增长 20%", "20"), ("增长 21%", "20"), ("增长 21%", ""), ("x" * 11, "g")))))
    assert list(scored) == [0.0, 0.6, 0.6, 0.5, 1.0, 0.6, 1.0, 0.8]
    assert values(spark, slots.render("{a}与{b}", {"a": F.lit("甲")}, {"a": "A", "b": "B"}))[0] == "甲与（B暂缺）"


def test_conversations(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(12)] + [(2, 0, "user", "q"), (2, 1, "user", "q2"), (2, 2, "assistant", "\n a \nb"), (2, 3, "assistant", "again"), (3, 0, "assistant", " ")]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    marks = spark.createDataFrame([(1, 3)], "conv_id int, upto int")
    assert {r.conv_id: (r.begin, r.end) for r in dialogue.compression(rows, 10, 8, marks).collect()} == {1: (3, 4), 2: (0, 0), 3: (0, 0)}
    assert {r.conv_id: (r.begin, r.end) for r in dialogue.compression(rows, 10, 8).collect()}[1] == (0, 4)
    assert [r.turn for r in dialogue.recent(rows, 2).where("conv_id = 1").orderBy("turn").collect()] == [10, 11]
    old = spark.createDataFrame([(2, "before")], "conv_id int, summary string")
    got = {r.conv_id: r.summary for r in dialogue.summaries(dialogue.question_answer_pairs(rows), old).collect()}
    assert got[2] == "before\n- Q: q2 -> a" and got[1].count("\n") == 5
    assert len({r.conv_id: r.summary for r in dialogue.summaries(dialogue.question_answer_pairs(rows), old, 20).collect()}[1]) == 20
    scores = spark.createDataFrame([(2, 2, 0.4, "high"), (2, 3, None, "unknown"), (1, 1, 0.2, "high")], "conv_id int, turn int, score double, risk string")
    found = dialogue.worst_first(dialogue.candidates(rows, scores), 4).collect()
    assert [(r.conv_id, r.turn) for r in found] == [(1, 1), (2, 2), (2, 3), (1, 3)] and found[1].query == "q2" and found[2].query == "q2"
    assert dialogue.candidates(rows, seen=scores.select("conv_id", "turn")).count() == 5
    asked = spark.createDataFrame([(1, "new"), (2, "again")], "conv_id int, question string")
    sent = [(r.role, r.text) for r in dialogue.messages(rows, old, asked, 2).where("conv_id = 2").orderBy("place").collect()]
    assert sent == [("system", "before"), ("assistant", "\n a \nb"), ("assistant", "again"), ("user", "again")]


def test_evidence(spark):
    part = lambda rows: spark.createDataFrame(rows, "query_id int, text string, source string, score double")
    got = evidence.assembled([part([(1, " a ", "news", 1.0)]), part([(1, "a", "kb", 0.9), (1, "b", "kb", 0.2), (1, "c", "kb", 0.5), (1, " ", "kb", 1.0)])], 3).orderBy("place").collect()
    assert [(r.place, r.text, r.source) for r in got] == [(1, "a", "news"), (2, "c", "kb"), (3, "b", "kb")]
    found = spark.createDataFrame([(1, 2, "x", "s", 0.9), (1, 1, "x", "s", 0.5), (1, 1, "y", "s", 0.3)], "query_id int, round int, text string, source string, score double")
    assert [tuple(r) for r in evidence.rounds_deduplicated(found).collect()] == [(1, "x", 1, "s", 0.5)]
    items = spark.createDataFrame([(1, 1, "T", "2024", "S", "x" * 900), (1, 2, None, None, None, "y")], "query_id int, place int, title string, date string, source string, text string")
    assert evidence.sources_text(items).first().text == "[1] T (2024) - source: S\n" + "x" * 800 + "\n\n[2] \ny"
    news = spark.createDataFrame([(1, 1, "a", "k", ""), (1, 2, "", "", None), (1, 11, "z", "", "")], "query_id int, place int, title string, keyword string, publish_time string")
    assert evidence.news_context(news).first().text == "- a | keyword: k"
    assert values(spark, evidence.truncated(F.lit("abcdef"), 3, "!"))[0] == "abc!"


def test_vector_store(spark):
    store = spark.createDataFrame([(1, "h", [1.0], 1), (2, "h", [2.0], 1)], "key int, text_hash string, vector array<double>, version int")
    new = spark.createDataFrame([(2, "g", [5.0]), (3, "g", [6.0]), (3, "g", [6.0])], "key int, text_hash string, vector array<double>")
    up = vectors.upserted(store, new, 2)
    assert sorted((r.key, r.vector[0], r.version) for r in up.collect()) == [(1, 1.0, 1), (2, 5.0, 2), (3, 6.0, 2)]
    assert vectors.removed(up, store.where("key = 2")).count() == 2
    assert vectors.missing_and_extra(up, store).collect()[0][:] == (3, "extra")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "key int, text string")
    cache = docs.where("key = 1").select(vectors.text_hash(F.col("text")).alias("text_hash"), F.array(F.lit(9.0)).alias("vector"))
    found, _ = vectors.embedded(docs, cache, None, 2)
    assert {r.key: (r.state, r.vector) for r in found.collect()}[4] == ("zero", [0.0, 0.0])
    found, fresh = vectors.embedded(docs, cache, lambda rows: rows.select("text_hash", F.array(F.lit(7.0)).alias("vector")), 1)
    assert {r.key: (r.state, r.vector[0]) for r in found.collect()} == {1: ("hit", 9.0), 2: ("miss", 7.0), 3: ("miss", 7.0), 4: ("miss", 7.0)} and fresh.count() == 2


def test_score_cards(spark):
    stages = spark.createDataFrame([(1, "a", "g", 0.5), (1, "b", "g", 0.1), (1, "c", "h", 0.9), (2, "a", "g", 0.3)], "run int, stage string, group string, score double")
    assert [(r.run, r.stage) for r in scorecard.worst_stages(stages, 2).orderBy("run", "place").collect()] == [(1, "b"), (1, "a"), (2, "a")]
    assert {r.run: r.text for r in scorecard.score_lines(stages).collect()}[1] == "- b: 0.10\n- a: 0.50\n- c: 0.90"
    named = values(spark, *(scorecard.stage_group(F.lit(s), {"retrieval": ["rerank"]}, {"slot_": "generation"}).alias(s) for s in ("rerank", "slot_x", "what")))
    assert list(named) == ["retrieval", "generation", None]
    n = F.lit
    got = values(spark, scorecard.term_search_score(n(4), n(2), n(0.25)), scorecard.vector_search_score(n(5), n(0.4)), scorecard.fusion_score(n(5), n(4), n(4), n(3)), scorecard.rerank_score(n(4), n(0.5), n(1)))
    assert [round(x, 6) for x in got] == [0.5, 0.72, 0.8, 0.425]
    files = lambda *names: spark.createDataFrame([(x,) for x in names], "file string")
    status = scorecard.pipeline_status(files("a", "a", "b", "c"), files("a", "b"), files("a"))
    assert {r.file: (r.n_read, r.status) for r in status.collect()} == {"a": (2, "imported"), "b": (1, "known"), "c": (1, "rejected")}


def test_dictionaries_and_lineage(spark):
    part = lambda rows: spark.createDataFrame(rows, "term string, value string, kind string")
    got = knowledge.merged_dictionary([part([("a", "1", "k"), ("b", "1", "k")]), part([("a", "2", "k")])])
    assert {r.term: r.value for r in got.collect()} == {"a": "2", "b": "1"}
    groups = spark.createDataFrame([("b", 1), ("a", 1), ("a", 1)], "term string, group_id int")
    assert knowledge.synonym_groups(groups).first().members == ["a", "b"]
    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (4, 2), (1, 4), (9, None)], "id int, parent int")
    got = knowledge.lineage(edges, spark.createDataFrame([(4,), (9,)], "id int")).collect()
    assert sorted(map(tuple, got)) == [(4, 1, 2), (4, 2, 1), (4, 3, 1)]


def test_sessions_and_sections(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "first question"), (2, 0, "user", "q")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: (r.n_turns, r.title) for r in dialogue.sessions(turns, 5).collect()} == {1: (2, "first"), 2: (1, "q")}
    new = spark.createDataFrame([(1, "user", "b", 2), (1, "user", "a", 1), (3, "user", "c", 1)], "conv_id int, role string, text string, at int")
    more = dialogue.appended(turns, new)
    assert sorted((r.conv_id, r.turn, r.text) for r in more.join(new.select("conv_id", "text"), ["conv_id", "text"]).collect()) == [(1, 2, "a"), (1, 3, "b"), (3, 0, "c")]
    assert dialogue.without_sessions(more, turns.where("conv_id = 1")).count() == 2
    text = evidence.full_text({"A": F.lit("x"), "B": F.lit(""), "C": evidence.bullets(F.array(F.lit("p"), F.lit(None), F.lit("q")))})
    assert values(spark, text)[0] == "【A】\nx\n\n【C】\n- p\n- q"


def test_macro_by_channel_and_tag(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], 1.0), ("a", ["x"], 0.0), ("b", ["y"], 0.5)], "channel string, tags array<string>, v double")
    metrics = rows.select("channel", "tags", *(F.col("v").alias(m) for m in evaluation.METRICS))
    got = {(r.channel, r.tags): (r.n_queries, r.recall) for r in evaluation.macro(metrics, "channel", "tags").collect()}
    assert got == {("a", "x"): (2, 0.5), ("a", "y"): (1, 1.0), ("b", "y"): (1, 0.5)}
