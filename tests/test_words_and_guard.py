"""Dictionaries of many words, segmentation, the guard on Chinese, metrics, sentiment, JSON and pools."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import extraction, matching, understanding
from marlstone.functions.segmentation import Segmenter, segmenter
from marlstone.operators import guard, news, retrieval


def plain_matches(text, words):
    out = []
    for word, value, place in words:
        at = [i for i in range(len(text or "")) if text.startswith(word, i)]
        if at:
            out.append((word, value, place, len(at), at[0]))
    return sorted(out, key=lambda x: (x[4], -len(x[0])))


TEXTS = ["abcabc", "aab bca", "", None, "x" * 50, "净利润增长 净利", "aaaa", "cabbage"]
WORDS = [("abc", "v1", 3), ("bc", "v2", 1), ("a", "v3", 2), ("aa", "v4", 0), ("净利润", "v5", 5), ("净利", "v6", 4), ("zz", "v7", 6)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_matcher_matches_loop(spark, block):
    find = matching.matcher(spark.createDataFrame([*WORDS, ("", "none", 0), (None, "none", 0), ("abc", "later", 9)], "word string, value string, place long"), block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("id", find(F.col("text")).alias("found"))
    got = docs.select("id", "found", matching.longest(F.col("found")).alias("l"), matching.first_declared(F.col("found")).alias("d"), matching.all_values(F.col("found")).alias("v"))
    for row in got.collect():
        want = plain_matches(TEXTS[row["id"]], WORDS)
        assert [tuple(x) for x in row["found"]] == want
        assert row["l"] == (min(want, key=lambda x: (-len(x[0]), x[0]))[1] if want else None)
        assert row["d"] == (min(want, key=lambda x: x[2])[1] if want else None)
        assert row["v"] == [x[1] for x in want]


def test_hundred_thousand_words(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randrange(5, 9))) for _ in range(130_000)})[:100_000]
    table = spark.createDataFrame([(w, w.upper(), i) for i, w in enumerate(words)], "word string, value string, place long")
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = docs.select("id", matching.matcher(table)(F.col("text")).alias("found"))
    known = set(words)
    for row in found.collect():
        text = texts[row["id"]]
        want = {text[i:j] for i in range(len(text)) for j in range(i + 5, min(i + 9, len(text) + 1)) if text[i:j] in known}
        assert {x["word"] for x in row["found"]} == want
    few = docs.select("id", matching.matcher(table.limit(5))(F.col("text")).alias("found"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(found) - size(few)) < 100


def test_long_mappings_give_what_short_ones_do(spark):
    names = {f"w{i}": f"n{i}" for i in range(60)} | {"公司": "c", "公司法": "l"}
    texts = ["w1 w12 w3", "公司法 w5", "none", None, "600519 w7"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in docs.select(extraction.longest_keyword(F.col("text"), names)).collect()]
    assert got == ["n12", "l", None, None, "n7"]
    assert [r[0] for r in docs.select(extraction.stock_code(F.col("text"), names)).collect()] == ["n1", "n5", None, None, "n7"]


def test_named_items_with_many_keywords(spark):
    items = spark.createDataFrame([(i, f"word{i}、x{i}yz") for i in range(300)] + [(900, "a"), (901, None)], "item_id int, keyword string")
    asked = spark.createDataFrame([(1, "see WORD7 and x250yz"), (2, "nothing"), (3, None)], "query_id int, query string")
    assert sorted(map(tuple, news.named_items(asked, items).collect())) == [(1, 7, 1), (1, 250, 2)]


def all_cuts(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in all_cuts(text[i:]):
            yield [text[:i], *rest]


def test_segmentation_is_the_most_probable_of_all():
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 40) for _ in range(12)}
        cutter = Segmenter(words)
        text = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randrange(0, 9)))
        allowed = [c for c in all_cuts(text) if all(len(w) == 1 or w in words for w in c)]
        weight = lambda cut: sum(map(cutter._weight, cut))
        got = cutter.cut(text)
        assert "".join(got) == text and got in allowed
        assert weight(got) == pytest.approx(max(map(weight, allowed)))


def test_segmenter_on_odd_texts(spark):
    words = spark.createDataFrame([("净利润", 50), ("净利润", 1), ("增长", None), ("", 5), (None, 5), ("公司", 0)], "word string, freq long")
    docs = spark.createDataFrame([(1, "公司净利润增长 50.3% ABC，的"), (2, None), (3, ""), (4, "龘" * 20000)], "id int, text string")
    got = {r["id"]: r["t"] for r in docs.select("id", segmenter(words, stop=["的"])(F.col("text")).alias("t")).collect()}
    assert got[1] == ["公司", "净利润", "增长", "50.3%", "abc"] and got[2] == got[3] == [] and len(got[4]) == 20000
    two = docs.select(segmenter(words, least=2)(F.col("text")).alias("t")).first()["t"]
    assert two == ["公司", "净利润", "增长", "50.3%", "abc"]


SOURCES = ["商汤科技2024年实现营业收入50.3亿元，同比增长36.4%。生成式AI业务收入占比达60%，研发投入18.7亿元。", "英伟达发布B200显卡，训练性能较H100提升4倍，微软的云平台已经部署十万张。"]
MADE_UP = ["公司宣布收购火星矿业集团全部股权。董事长因涉嫌内幕交易被立案调查。", "腾讯于第四季度全资收购了月之暗面公司，交易金额尚未披露。"]
PARAPHRASES = ["商汤科技去年营业收入达到50.3亿元，同比增长了36.4%。", "英伟达的B200显卡训练性能提升到H100的4倍。"]


@pytest.mark.parametrize("segmented", [False, True])
def test_guard_catches_made_up_chinese(spark, segmented):
    known = "商汤 科技 实现 营业 收入 营业收入 同比 增长 生成式 业务 占比 研发 投入 英伟达 发布 显卡 训练 性能 提升 微软 云平台 部署 公司 宣布 收购 火星 矿业 集团 全部 股权 董事长 涉嫌 内幕 交易 立案 调查 腾讯 季度 全资 月之暗面 金额 披露 去年 达到"
    words = segmenter(spark.createDataFrame([(w, 10) for w in known.split()], "word string, freq long"), least=2) if segmented else None
    answers = spark.createDataFrame([(i, a) for i, a in enumerate(MADE_UP + PARAPHRASES)], "id int, answer string")
    sources = spark.createDataFrame([(i, s) for i, s in itertools.product(range(4), SOURCES)], "id int, text string")
    got = {r["id"]: r for r in guard.check(answers, sources, ["id"], [], words=words).collect()}
    for i in (0, 1):
        assert got[i]["grounding"] == 0.0 and got[i]["n_unanchored"] == got[i]["n_sentences"] and got[i]["risk"] != "low"
    for i in (2, 3):
        assert got[i]["n_unanchored"] == 0 and got[i]["grounding"] == 1.0


@pytest.mark.parametrize(
    "text,want",
    [
        ("营业收入同比增长25%，达到100亿元", {}),
        ("净利润同比下降15%", {}),
        ("研发人员1200名", {}),
        ("营业收入约50.3亿元，净利润 3,200万元，研发投入为18.7亿元", {"revenue": (50.3, "亿元"), "net_profit": (3200.0, "万元"), "rd_expense": (18.7, "亿元")}),
        ("营收达100亿", {"revenue": (100.0, "亿")}),
        ("GPU集群规模超过2.5万卡，API日均调用量300万次", {"gpu_count": (25000.0, "卡"), "api_calls": (300.0, "万次")}),
    ],
)
def test_metrics_stand_directly_behind_their_name(spark, text, want):
    got = spark.range(1).select(extraction.metrics(F.lit(text)).alias("m")).first()["m"]
    assert {x["metric"]: (x["value"], x["unit"]) for x in got} == want


def test_sentiment_words(spark):
    texts = ["公司回购股份超预期", "公司违规被处罚", "增长但预警", "平静"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in docs.select(extraction.sentiment(F.col("t"))).collect()] == ["positive", "negative", "neutral", "neutral"]


@pytest.mark.parametrize(
    "text,want",
    [('x "{" {"b":1}', '{"b":1}'), ('{"a": "x {"b":1}', '{"b":1}'), ('say "hi {" then [1, {"c": "]"}] end', '[1, {"c": "]"}]'), ("{not json} [2]", "[2]"), ('{"a": 1', None), ("[" * 3000 + "1", None), ('{"a":\n "x\ty"}', '{"a":\n "x\ty"}')],
)
def test_json_behind_quoted_and_unclosed_braces(text, want):
    got = understanding.first_json(text)
    assert got == want and (got is None or json.loads(got, strict=False) is not None)


def test_pools_are_searched_one_by_one(spark):
    docs = spark.createDataFrame([(i, "a b" if i < 30 else "a c", "big") for i in range(40)] + [(100, "a d e f", "small"), (101, "a b", "other"), (102, "a d e f", "other")], "doc_id long, text string, pool string")
    asked = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    hits = retrieval.in_pools(docs, ["small", "big", "other"], lambda d: retrieval.jaccard_search(d, asked, 3))
    assert {(r["pool"], r["rank"], r["key"]) for r in hits.collect()} == {("big", 1, 0), ("big", 2, 1), ("big", 3, 2), ("small", 1, 100), ("other", 1, 101), ("other", 2, 102)}
    best = retrieval.pool_search(hits, docs, {"small": 3.0}, 10)
    assert [(r["pool"], r["key"], r["rank"]) for r in best.orderBy("rank").collect()] == [("small", 100, 1), ("big", 0, 2)]
    cross = retrieval.cross_pool(hits, docs, "small", 5, 1)
    assert {(r["pool"], r["key"]) for r in cross.collect()} == {("small", 100), ("big", 0)}
    wide = retrieval.cross_pool(hits, docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))), "small", 5, 2)
    assert {(r["pool"], r["key"]) for r in wide.collect()} == {("small", 100), ("big", 0), ("big", 1), ("other", 101), ("other", 102)}
