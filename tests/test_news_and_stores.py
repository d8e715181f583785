"""News, instruments, readers and reports on small cases."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import indicators, news, retrieval
from marlstone.sources import readers


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_events_of_a_day(spark):
    rows = [("a", "x", None, "2024-01-02 10:00", "u1"), ("a", "y", "s", "2024-01-02 11:00", "u2"), ("", "z", "s", "2024-01-02", "u3"), (None, "chip", "s", "2024-01-02", "u4"), ("b", "x", "s", "2024-01-03", "u5"), ("c", "x", "s", None, "u6")]
    items = spark.createDataFrame(rows, "title string, content string, source string, publish_time string, url string")
    assert sorted(r.url for r in news.date_events(items, "2024-01-02").collect()) == ["u1", "u3", "u4"]
    assert [r.url for r in news.date_events(items, "2024-01-02", "chip").collect()] == ["u4"] and news.date_events(items, "2024-01-02", most=1).count() == 1


def test_named_items_and_search_words(spark):
    asked = spark.createDataFrame([(1, "华为芯片 news"), (2, "none"), (3, None)], "query_id int, query string")
    items = spark.createDataFrame([(7, "芯片、a"), (8, "NEWS"), (9, None), (10, "芯")], "item_id int, keyword string")
    assert sorted((r.query_id, r.item_id) for r in news.named_items(asked, items).collect()) == [(1, 7), (1, 8)]
    words = values(spark, news.search_words(F.lit("nvidia stock"), F.array(F.lit("AI"), F.lit("GPU"), F.lit("x"), F.lit("GPU")), ["AI"], {"nvidia": "英伟达", "gpu": "显卡"}))[0]
    assert words == ["nvidia stock", "英伟达", "GPU", "显卡"]
    assert values(spark, news.search_words(F.lit("q"), F.lit(None).cast("array<string>"), [], {"z": "y"}))[0] == ["q"]


def test_plain_texts(spark):
    got = values(spark, news.plain_report(F.lit(""), F.array(*(F.lit(f"t{i}") for i in range(7))), F.array(F.lit("c"))).alias("r")).r
    assert got.title == "report" and got.findings == ["t0", "t1", "t2", "t3", "t4"] and got.summary.endswith("7 sources.")
    sentence = news.narrative(F.lit("甲"), F.lit("2024"), F.array(F.struct(F.lit("营收").alias("metric"), F.lit(1.5).alias("value")), F.struct(F.lit("other").alias("metric"), F.lit(2.0).alias("value"))), {"营收": " 亿元"})
    assert values(spark, sentence)[0] == "甲 (2024): 营收 1.50 亿元, other 2.0."


def test_instruments_and_signals(spark):
    rows = spark.createDataFrame([("510300", "沪深300ETF"), ("600519", "贵州茅台"), ("159915", "创业板ETF"), (None, "x")], "code string, name string")
    assert [r.f for r in rows.select(indicators.is_fund(F.col("code")).alias("f")).collect()] == [True, False, True, False]
    assert [r.code for r in indicators.find_instruments(rows, "ETF").collect()] == ["159915", "510300"]
    marks = spark.createDataFrame([(80.0, False), (20.0, False), (50.0, False), (0.0, True), (None, None)], "rsi double, is_flat boolean")
    assert [r.signal for r in indicators.signals(marks).collect()] == ["overbought", "oversold", "neutral", "flat", None]
    batch = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "key int, n int, v string")
    assert sorted((r.key, r.v) for r in retrieval.last_of_batch(batch, "key", [F.col("n")]).collect()) == [(1, "new"), (2, "only")]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.txt").write_text("\n".join(f"l{i}" for i in range(60)))
    (tmp_path / "b" / "x.txt").write_text("other")
    assert [r.line for r in readers.preview(spark, str(tmp_path), "a/x.txt", 3).orderBy("line_no").collect()] == ["l0", "l1", "l2"]
    assert readers.preview(spark, str(tmp_path), "a/x.txt", 900).count() == 50
    for bad in ("../x.txt", "/etc/passwd", "a/../../x", "file:///etc/passwd"):
        with pytest.raises(ValueError):
            readers.preview(spark, str(tmp_path), bad)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where(F.col("path").contains("/a/")).select("path")
    got = {r.path.split("/")[-2]: r.imported for r in readers.list_directory(spark, str(tmp_path), files).collect()}
    assert got == {"a": True, "b": False}
    pages = spark.createDataFrame([("f", 2, "two"), ("f", 1, "one"), ("f", 3, " "), ("g", 1, None)], "file string, page int, text string")
    assert [tuple(r) for r in readers.joined_pages(pages).collect()] == [("f", "one\n\ntwo", 2)]
    read = spark.createDataFrame([(None,), ("bad line",), (None,)], "error string")
    assert {r.outcome: r.n for r in readers.outcome_counts(read).collect()} == {"read": 2, "bad line": 1}


def test_ingest_news(spark):
    from marlstone.operators import chunking, ingest, knowledge

    rules = ingest.Rules(["profit"], {"report": ["profit"]}, script=r"\p{L}", min_chars=20, steps=("html", "whitespace"))
    rows = [("Profit up", "<b>The profit of 2020-01-01 rose a lot</b>", "s", "2024-03-05 10:00", "u1", "k"), ("Profit up", "again the profit", "s", "2024-03-06", "u2", "k"), ("", "no title but profit here, long enough", "s", None, "u3", "k"), ("Short", "profit", "s", "x", "u4", "k"), (None, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "title string, content string, source string, publish_time string, url string, keyword string")
    none = spark.createDataFrame([], "key string")
    new, judged = ingest.ingest_news(items, none, rules)
    got = {r.url: r for r in new.collect()}
    assert set(got) == {"u1", "u2", "u3"} and got["u1"].publish_date == "2024-03-05" and got["u1"].text.startswith("Profit up\n\nThe profit")
    assert {r.outcome: r.n for r in ingest.outcome_counts(judged, []).collect()} == {"accepted": 3, "short": 1, "empty": 1}
    again, _ = ingest.ingest_news(items, new.select("key"), rules)
    assert again.count() == 0
    assert [r.url for r in ingest.news_metadata(items).orderBy("url").collect()] == ["u1", "u4"]
    assert ingest.news_metadata(items, items.where("title = 'Short'")).count() == 1
    chunks = spark.createDataFrame([(1, 0, "a profit"), (1, 1, "x" * 60), (2, 0, "none")], "doc_id int, chunk_id int, text string")
    report = {r.doc_id: r for r in chunking.chunk_report(chunks, ["profit", "loss"]).collect()}
    assert (report[1].n_chunks, report[1].least, report[1].most, report[1].n_short, report[1].words) == (2, 8, 60, 1, ["profit"]) and report[2].words == []


def test_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("12345")
    (tmp_path / "empty").mkdir()
    got = {r.store: (r.n_files, r.bytes, r.modified is not None) for r in readers.inventory(spark, {"a": str(tmp_path / "a"), "e": str(tmp_path / "empty")}).collect()}
    assert got == {"a": (1, 5, True), "e": (0, 0, False)}


def test_a_keyword_brings_its_first_items_only(spark, monkeypatch):
    items = spark.createDataFrame([(i, ("hot、cold", "hot", "COLD、hot")[i % 3]) for i in range(300)] + [(7, "hot")], "item_id int, keyword string")
    asked = spark.createDataFrame([(1, "a hot day"), (2, "cold"), (3, "hot and cold")], "query_id int, query string")
    joined, plain = [], news.if_few
    monkeypatch.setattr(news, "if_few", lambda rows: joined.append(rows.count()) or plain(rows))
    got = sorted((r.query_id, r.place, r.item_id) for r in news.named_items(asked, items, 4).collect())
    cold = [i for i in range(300) if i % 3 != 1]
    assert got == [(q, k + 1, i) for q, ids in ((1, range(4)), (2, cold[:4]), (3, range(4))) for k, i in enumerate(ids)]
    assert joined == [8]
