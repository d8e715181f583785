from pyspark.sql import functions as F

from marlstone.functions import cleaning, extraction, predicates, tokens, understanding
from marlstone.operators import chunking, evaluation, indicators, knowledge, retrieval
from marlstone.sources import readers
from marlstone.streaming import ingest


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_cleaning_rules(spark):
    check = lambda f, text, want: one(spark, text, f) == want
    assert check(cleaning.strip_tags, "a<b>c</b> 1 < 2", "ac 1 < 2")
    assert check(cleaning.strip_urls, "见https://a.b/c?d=1这里", "见这里")
    assert check(cleaning.strip_emails, "x a.b@c.org y", "x  y")
    assert check(cleaning.strip_control, "a\x00b\tc\n", "ab\tc\n")
    assert check(cleaning.strip_zero_width, "a​b﻿c", "abc")
    assert check(cleaning.collapse_repeated, "wow!!!!!! 1000000", "wow!!! 1000000")
    assert check(cleaning.collapse_whitespace, "a\n\n\n\nb  c。  d", "a\n\nb c。d")
    assert check(cleaning.dedup_paragraphs, "a\n\nb\n\n a\n\n\n\nb", "a\n\nb\n\n")
    assert check(cleaning.strip, "　 a b \n", "a b")
    assert check(cleaning.strip_news_html, "<p>a&amp;lt;&nbsp;</p>", "a&lt;")
    assert check(cleaning.drop_boilerplate, "x\nAll Rights Reserved.\n" + "y" * 30 + " copyright " + "z" * 30, "x\n" + "y" * 30 + " copyright " + "z" * 30)


def test_clean_frame_takes_nulls_and_full_width(spark):
    rows = spark.createDataFrame([(1, "Ａ１<b>"), (2, None), (3, "")], "id int, text string")
    assert [r.c for r in cleaning.clean_frame(rows, "text", "c").orderBy("id").collect()] == ["A1", None, ""]


def test_tokens(spark):
    assert one(spark, "AB 50.3% 净利润增长", tokens.index_tokens) == ["ab", "净利润增长", "净利润", "利润增", "润增长", "50.3%"]
    assert one(spark, None, tokens.index_tokens) == []
    assert one(spark, "中文字", tokens.query_tokens) == ["中文字", "中文", "文字"]
    assert one(spark, "中文abcde", tokens.estimate_tokens) == 4


def test_filters_treat_missing_fields(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "b", None)], "id int, s string, n int")
    ids = lambda tree, soft=frozenset(): [r.id for r in rows.where(predicates.metadata_filter(tree, soft)).orderBy("id").collect()]
    assert ids({"s": {"$ne": "a"}}) == [3]
    assert ids({"s": {"$ne": "a"}}, frozenset(["s"])) == [2, 3]
    assert ids({"n": {"gte": 5, "$lt": 7}}) == [1]
    assert ids({"$not": {"s": "a"}}) == [2, 3]
    assert ids({"$exists": "s"}) == [1, 3] and ids({"$not_exists": ["n"]}) == [3]
    assert ids({"s": ["a", "b"], "n": {"$unknown": 1}}) == [1, 3]


def test_extraction(spark):
    assert one(spark, "发布于2024年3月5日，2023-01-02", extraction.publish_date) == "2024-03-05"
    assert one(spark, "2024年第二季度", extraction.publish_date) == "2024-06"
    assert one(spark, "2024H1", extraction.fiscal_period) == "2024H1"
    assert one(spark, "代码 600519 与 20240101", extraction.stock_code) == "600519.SH"
    assert one(spark, "净利润为12.5亿元", extraction.metrics)[0].value == 12.5
    assert one(spark, "先看空后看多", lambda c: extraction.last_mentioned(c, {"看多": "bullish", "看空": "bearish"})) == "bullish"
    assert one(spark, "股价上涨突破", extraction.sentiment) == "positive"


def test_json_in_text():
    assert understanding.first_json('x {"a": "}\\"{", "b": [1]} y') == '{"a": "}\\"{", "b": [1]}'
    assert understanding.first_json("{1} ```json\n[2]\n```") == "[2]"
    assert understanding.first_json("{ open [3] ") == "[3]" and understanding.first_json(None) is None


def test_query_dates(spark):
    rows = spark.createDataFrame([("近一周走势",), ("2024-01-05 公告",), ("none",)], "text string")
    got = [tuple(map(str, r[0])) for r in rows.select(understanding.date_range(F.col("text"), F.lit("2024-03-10").cast("date"))).collect()]
    assert got == [("2024-03-03", "2024-03-10"), ("2024-01-05", "2024-01-05"), ("None", "None")]


def test_chunks_cover_the_text(spark):
    text = ("Satz eins. " * 30 + "\n") * 4 + "x" * 1200
    parts = chunking.merge_small(chunking.split_text(text, 500), 50)
    assert "".join(p for _, p in parts) == text
    assert all(text[at : at + len(p)] == p for at, p in parts)
    assert all(len(p) <= 550 for _, p in parts)
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id int, text string")
    chunks = chunking.chunk_documents(rows).orderBy("chunk_id").collect()
    assert {r.doc_id for r in chunks} == {1} and chunks[1].text.startswith(parts[0][1][-50:])


def test_context_budget(spark):
    rows = [(1, 10, 1, 0.9, "a" * 30 + ". " + "b" * 30), (1, 11, 2, 0.8, "c. " * 20), (1, 12, 3, 0.7, "d" * 50)]
    items = spark.createDataFrame(rows, "query_id int, key long, rank int, score double, text string")
    got = {r.key: (r.used_chars, r.status) for r in chunking.build_context(items, 100, 10).collect()}
    assert got[10] == (62, "kept") and got[11] == (38, "cut") and got[12] == (0, "dropped")


def test_bm25_clamp_and_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "a"), (4, ""), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "c c"), (3, "zz")], "query_id int, query string")
    hits = {(r.query_id, r.key): r.score for r in retrieval.bm25_search(docs, asked).collect()}
    assert set(hits) == {(1, 1), (1, 2), (1, 3), (2, 2)} and hits[(1, 3)] > 0
    single = retrieval.bm25_search(docs, asked.where("query_id = 2").withColumn("query", F.lit("c"))).first().score
    assert abs(hits[(2, 2)] - 2 * single) < 1e-5


def test_fusion_counts_a_key_once_per_channel(spark):
    hits = spark.createDataFrame([(1, 7, 1, 2.0, "a", 0), (1, 7, 2, 1.0, "a", 0), (1, 8, 1, 5.0, "b", 1)], "query_id int, key long, rank int, score double, channel string, place int")
    got = {r.key: r for r in retrieval.fuse(hits, {"a": 0.5, "b": 0.5}, 5).collect()}
    assert got[7].n_channels == 1 and got[7].rank == 1 and got[7].score == got[8].score


def test_cosine_takes_zero_and_null_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0])], "vec_id long, embedding array<float>")
    hits = retrieval.cosine_search(rows, rows.where("vec_id = 0"), 4).collect()
    assert retrieval.cosine_search(rows, rows.where("vec_id <> 2"), 1, block_values=2).count() == 3
    assert [(h.key, h.score) for h in sorted(hits, key=lambda h: h.rank)] == [(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, key long, rank int")
    qrels = spark.createDataFrame([(1, 6, 3), (1, 9, 1), (2, 1, 1)], "query_id int, key long, grade int")
    got = {r.query_id: r for r in evaluation.ranking_metrics(hits, qrels, 2).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr, got[1].map) == (0.5, 0.5, 0.5, 0.25)
    assert got[2].ndcg == 0 and abs(got[1].ndcg - round((7 / 1.5849625) / (7 + 1 / 1.5849625), 6)) < 1e-5


def test_flat_series(spark):
    bars = spark.createDataFrame([("s", i, 1.0, 1.0, 1.0, 1.0, 1) for i in range(20)], "symbol string, date int, open double, high double, low double, close double, volume int")
    last = indicators.rsi(bars).orderBy(F.desc("date")).first()
    assert last.rsi == 0 and last.is_flat
    assert indicators.macd(bars).count() == 0


def test_knowledge_base(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, digest string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "key string, digest string")
    assert {r.key: r.change for r in knowledge.difference(old, new).collect()} == {"a": "removed", "b": "edited", "c": "unchanged", "d": "added"}
    knowledge.save_snapshot(old, str(tmp_path), 1)
    assert knowledge.load_snapshot(spark, str(tmp_path), 1).count() == 3
    assert {r.key for r in knowledge.upsert(old, new.where("key = 'd'").withColumn("key", F.lit("ax")), F.lit("a"), "key").collect()} == {"b", "c", "ax"}


def test_readers_isolate_failures(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "t", "content": "c"}\nbroken\n{"text": "x", "meta": {"k": "v"}}\n{"source": "s"}\n')
    (tmp_path / "b.txt").write_text("  hello \n")
    (tmp_path / "c.json").write_text('[{"content": "one"}, {"text": "two", "source": "s"}]')
    (tmp_path / "d.pdf").write_bytes(b"bad")
    rows = readers.ingest_directory(spark, str(tmp_path), lambda data: data.decode("utf-16")).collect()
    assert sorted(r.text for r in rows if not r.error) == ["hello", "one", "t\n\nc", "two", "x"]
    assert sorted(r.error[:8] for r in rows if r.file != "d.pdf" and r.error) == ["bad line", "no text"]
    assert sum(r.file == "d.pdf" and r.error is not None for r in rows) == 1
    readers.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), str(tmp_path / "out"), "Report", ["n"], "%d %s")
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_stream_counts_like_a_batch(spark, sf):
    import pathlib
    import shutil
    import tempfile

    folder = pathlib.Path(tempfile.mkdtemp())
    shutil.copy(f"{sf}/events.parquet", folder)
    schema = spark.read.parquet(str(folder)).schema
    counts = ingest.windowed_counts(ingest.deduplicated(ingest.read_stream(spark, str(folder), schema), "event_id", "ts"), "ts", "event_type", late=None)
    running = counts.writeStream.format("memory").queryName("windowed").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    batch = spark.read.parquet(str(folder)).groupBy(F.window("ts", "10 minutes").start.alias("start"), "event_type").count()
    late = spark.table("windowed").withColumn("start", F.col("start").cast("timestamp_ntz"))
    assert late.count() > 0
    assert late.join(batch, ["start", "event_type"]).where("n <> count").count() == 0


def test_cleaning_matches_its_patterns(spark):
    assert one(spark, "看www.a.cn/x?y=1和www.b.org。", cleaning.strip_urls) == "看和。"
    assert one(spark, "注：  甲，\t乙；  丙、  丁", cleaning.collapse_whitespace) == "注：甲，乙；丙、 丁"
    assert one(spark, "it&#39;s &quot;x&quot;", cleaning.strip_news_html) == "it's \"x\""
    assert one(spark, "正文\n关注微信公众号\n来源：网", cleaning.drop_boilerplate) == "正文"
    assert one(spark, None, cleaning.dedup_paragraphs) is None
    long = "\n\n".join(f"p{i % 3000}" for i in range(20_000))
    assert one(spark, long, cleaning.dedup_paragraphs) == "\n\n".join(f"p{i}" for i in range(3000))


def test_dates_by_precedence(spark):
    cases = {"2024年5月": "2024-05", "2024H2 报告": "2024-12", "2023年 2024-06-01": "2023", "于2024/6/1": "2024-06-01", "2024-06 起": "2024-06", "20240601": "2024-06-01", "无": None, "2024 年 3 月 9 号": "2024-03-09"}
    for text, want in cases.items():
        assert one(spark, text, extraction.publish_date) == want, text


def test_more_extraction(spark):
    text = "华为技术有限公司与中芯科技公司，营业总收入约1,234.5亿元；GPU集群2万卡；接口日均调用量30万次，支付5万美元、20元。"
    found = {r.metric: (r.value, r.unit) for r in one(spark, text, extraction.metrics)}
    assert found["revenue"] == (1234.5, "亿元") and found["gpu_count"] == (20000.0, "卡") and found["api_calls"] == (30.0, "万次")
    assert [tuple(x) for x in one(spark, text, extraction.amounts)] == [(1234.5, "亿元"), (5.0, "万美元"), (20.0, "元")]
    assert all(len(x) >= 4 for x in one(spark, text, extraction.companies))
    assert one(spark, "价值5美元", extraction.currency) == "USD" and one(spark, "x", extraction.currency) == "CNY"
    assert one(spark, "结论。置信度：高", extraction.confidence) == "high" and one(spark, "无", extraction.confidence) == ""
    assert one(spark, "头【关键信号】\n- 一\n• 二\n\n【风险】三", lambda c: extraction.section_items(c, "关键信号")) == ["一", "二"]
    assert one(spark, "涨涨跌", lambda c: extraction.heuristic_verdict(c, "涨", "跌", F.array(F.lit(30.0), F.lit(-5.0)))) == "bullish"
    rows = spark.createDataFrame([({"营收": 1.0, "revenue_x": 2.0, "别的": 3.0},)], "m map<string,double>")
    assert rows.select(extraction.rename_metrics(F.col("m"), {"revenue": ["收入", "营收"]})).first()[0] == {"revenue": 1.0, "revenue_x": 2.0, "别的": 3.0}
    assert spark.range(1).select(extraction.search_queries(F.array(F.lit("gpu_count")), F.array(F.lit("甲公司")), {"revenue": "营业收入", "gpu_count": "GPU算力"}, ["a", "b"])).first()[0] == ["GPU算力 分析", "甲公司 业务进展"]
    types = spark.createDataFrame([("年报", "x"), (None, "analysis:1"), ("own", "x")], "t string, s string")
    assert [r[0] for r in types.select(extraction.normalised_type(F.col("t"), F.col("s"))).collect()] == ["financial_report", "analysis", "own"]
    signals = F.array(F.struct(F.lit("a").alias("signal"), F.lit(9).alias("severity"), F.lit("not there").alias("evidence")), F.struct(F.lit("b").alias("signal"), F.lit(2).alias("severity"), F.lit("知识库: x").alias("evidence")))
    got = spark.range(1).select(extraction.assessment_problems(F.lit("up"), F.lit("high"), signals, F.lit("source text"), ["bullish"], ["high"])).first()[0]
    assert got.errors == ["verdict"] and got.warnings == ["severity 0", "evidence 0"]
    assert spark.range(1).select(extraction.query_quality(F.array(F.lit("a"), F.lit("bb")))).first()[0] == round(0.4 * 2 / 3 + 0.6, 4)
    assert spark.range(1).select(extraction.extraction_quality(F.array(F.lit("a")), [F.array(F.lit(1)), F.array().cast("array<int>")], ["a", "b"])).first()[0] == 0.4


def test_query_words_and_intent(spark):
    classes = [("entity", 3.0, ["茅台"]), ("finance", 2.0, ["净利润", "利润"]), ("industry", 1.5, ["白酒"]), ("action", 1.0, ["分析"])]
    words = lambda q: [(x.term, x.weight, x.origin) for x in one(spark, q, lambda c: understanding.weighted_keywords(c, classes, ["的"]))]
    assert words("茅台的净利润分析") == [("茅台", 3.0, "entity"), ("净利润", 2.0, "finance"), ("利润", 2.0, "finance"), ("分析", 1.0, "action")]
    assert [w for w, _, o in words("昇腾芯片 白酒 x") if o == "residual"] == ["昇腾", "腾芯", "芯片", "昇腾芯片"]
    assert one(spark, "茅台的净利润", lambda c: understanding.has_specific_intent(understanding.weighted_keywords(c, classes, ["的"]))) is False
    assert "净利润" in one(spark, "净利润xx", lambda c: understanding.index_query_tokens(c, understanding.weighted_keywords(c, classes, [])))
    queries = spark.createDataFrame([(1, "a", False), (2, "a", True)], "query_id int, term string, specific boolean")
    synonyms, concepts = spark.createDataFrame([("a", 1), ("b", 1)], "term string, group_id int"), spark.createDataFrame([("a", "z")], "term string, related string")
    assert sorted(map(tuple, understanding.expand(queries, synonyms, concepts=concepts).collect())) == [(1, "b", 1.5), (1, "z", 0.6), (2, "b", 1.5)]
    dates = {"2024年1月5日": ("2024-01-05", "2024-01-05"), "最近一周": ("2024-03-03", "2024-03-10"), "上月": ("2024-02-09", "2024-03-10"), "20231301": ("None", "None")}
    for text, want in dates.items():
        got = one(spark, text, lambda c: understanding.date_range(c, F.lit("2024-03-10").cast("date")))
        assert (str(got.gte), str(got.lte)) == want, text
    rows = spark.createDataFrame([("2024-03-05",), ("2024-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    span = understanding.date_range(F.lit("最近一周"), F.lit("2024-03-10").cast("date"))
    assert [str(r.d) for r in rows.where(understanding.in_range(F.col("d"), span)).collect()] == ["2024-03-05", "None"]


def test_json_scan_is_linear():
    assert understanding.first_json("{" * 200_000 + "[1]") == "[1]"
    assert understanding.first_json("{ a [1, [2]] b") == "[1, [2]]"
    assert understanding.first_json('{ "unclosed [3]') == "[3]"


def test_detector_counts_longest_words(spark):
    rules = [("report", ["年度报告", "资产负债表", "报告"], 2), ("quarter", r"Q[1-3]\s*报告", 1)]
    label = lambda t: one(spark, t, lambda c: predicates.document_detector(c, rules, long="news"))
    assert label("年度报告") == "other" and label("年度报告 报告") == "report" and label("Q1 报告") == "quarter" and label("x" * 101) == "news" and label(None) == "other"


def test_ingest_keeps_what_rows_have(spark, tmp_path):
    from marlstone.operators import ingest as chain

    rules = chain.Rules(["利润"], {"report": ["利润", "季度"], "news": ["报道"]}, min_chars=10, pools={"report": "finance"}, companies={"茅台": "贵州茅台"}, sectors={"消费": ["白酒"]})
    long = "茅台公司发布2024年3月5日季度利润，白酒行业利润增长。" * 2
    rows = spark.createDataFrame([(1, long, None), (2, long, "own"), (3, "利润", None), (4, " ", None), (5, None, None), (6, "天气很好" * 20, None)], "id int, text string, company string")
    got = {r.id: r for r in chain.ingest(rows, rules).collect()}
    assert [got[i].reject_reason for i in range(1, 7)] == [None, None, "short", "empty", "empty", "irrelevant"]
    assert (got[1].company, got[2].company, got[1].publish_date, got[1].sector, got[1].pool) == ("贵州茅台", "own", "2024-03-05", "消费", "finance")
    assert got[6].gate_reason == "no_keyword" and got[6].doc_type is None
    assert {r.outcome: r.n for r in chain.outcome_counts(chain.ingest(rows, rules), []).collect()} == {"accepted": 2, "short": 1, "empty": 2, "irrelevant": 1}
    chain.write_pools(chain.ingest(rows, rules), str(tmp_path / "pools"))
    assert spark.read.parquet(str(tmp_path / "pools")).groupBy("pool").count().collect()[0][:] == ("finance", 2)


def test_titles_versions_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "a")], "id int, title string")
    assert {r.id for r in knowledge.titled(rows, "title", [F.col("id")]).collect()} == {1}
    assert {r.id for r in knowledge.titled(rows, "title", [F.col("id")], "keep").collect()} == {1, 2, 3}
    both = knowledge.united({"x": rows, "y": rows.select("id").withColumn("extra", F.lit(1))})
    assert both.count() == 8 and set(both.columns) == {"id", "title", "source", "extra"}
    path = str(tmp_path / "kb")
    assert knowledge.current_version(spark, path) is None and knowledge.next_version(spark, path) == 1
    knowledge.save_snapshot(rows, path, 1)
    knowledge.save_snapshot(rows.where("id > 1"), path, 2)
    assert knowledge.versions(spark, path) == [1, 2] and knowledge.load_snapshot(spark, path, 2).count() == 3
    rows.where("id > 1").withColumn("title", F.lit("changed")).write.mode("overwrite").parquet(f"{path}/v=2")
    try:
        knowledge.load_snapshot(spark, path, 2)
        raise AssertionError("a changed text passed")
    except ValueError:
        pass
    docs = spark.createDataFrame([("ab1",), ("abc",), ("b",), (None,)], "key string")
    new = spark.createDataFrame([("ab2",)], "key string")
    assert sorted(r.key or "" for r in knowledge.upsert(docs, new, F.lit("ab"), "key").collect()) == ["", "ab2", "b"]


def test_class_patterns_count_once(spark):
    kinds = {"a": ["x"], "b": ["y"]}
    label = lambda t: one(spark, t, lambda c: predicates.keyword_class(c, kinds, patterns={"b": r"\d"}))
    assert label("x y 5").label == "b" and label("x y").label == "a" and label("7").label == "b" and label("-").label == "other"
