"""Metadata, metrics, entities, sentiment and verdicts by rules, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matching
from .tokens import distinct_hits

# Date patterns in order of precedence, with what they give.
DATES = (
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]", "day"),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月", "month"),
    (r"(\d{4})\s*年?\s*第([一二三四])季度", "period"),
    (r"(\d{4})\s*([QH]\d)", "period"),
    (r"(\d{4})\s*年", "year"),
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "day"),
    (r"(\d{4})[-/](\d{1,2})", "month"),
    (r"(\d{4})(\d{2})(\d{2})", "day"),
)
# The month in which a quarter or a half-year ends.
PERIOD_ENDS = {"一": "03", "二": "06", "三": "09", "四": "12", "Q1": "03", "Q2": "06", "Q3": "09", "Q4": "12", "H1": "06", "H2": "12"}
# Sentiment words of titles.
POSITIVE = ["增长", "上升", "利好", "突破", "创新高", "盈利", "分红", "回购", "超预期", "上涨"]
NEGATIVE = ["下跌", "亏损", "暴雷", "处罚", "违规", "退市", "减持", "下滑", "预警", "暴跌"]
# Metric patterns; the value stands directly behind the name and is the first group, a factor word the second and the unit the third.
METRICS = {
    "revenue": r"(?:营业(?:总)?收入|营收)[约达为]?\s*([\d,.]*\d)\s*(亿|万|千|百)?(元|美元|港元)?",
    "net_profit": r"净利润[约达为]?\s*([\d,.]*\d)\s*(亿|万|千|百)?(元|美元|港元)?",
    "rd_expense": r"研发(?:费用|投入|支出)[约达为]?\s*([\d,.]*\d)\s*(亿|万|千|百)?(元|美元|港元)?",
    "gpu_count": r"(?:GPU|芯片|训练集群)[^，。]{0,10}?([\d,.]*\d)\s*(万)?(卡)",
    "api_calls": r"(?:API|接口)[^，。]{0,10}?(?:调用量|日均|月均)[^，。]{0,5}?([\d,.]*\d)\s*(万|亿)?(次)",
}
# Entity patterns.
COMPANY = r"[\x{4e00}-\x{9fa5}]{2,6}(?:集团|公司|控股|股份|科技|银行|证券|基金|保险|信托|租赁)(?:有限公司|股份有限公司)?"
MONEY = r"([\d,.]*\d)\s*(亿|万|千|百)?\s*(元|美元|港元|人民币)"
# What older stores call their document types.
TYPE_NAMES = {"新闻报道": "news", "年报": "financial_report", "季报": "financial_report", "研究报告": "research", "行业分析": "research", "其他": "other"}
# The metadata that a document should have.
METADATA_FIELDS = ("source", "company", "date", "fiscal_period", "currency", "doc_type", "text_length")
# How texts state their confidence.
CONFIDENCE = (("high", r"置信度[】:：]\s*高|高置信"), ("low", r"置信度[】:：]\s*低|低置信"), ("medium", r"置信度[】:：]\s*中|中置信"))


def publish_date(text: Column) -> Column:
    """The date of the first pattern that occurs: day, month, end of the quarter or half-year, or year; null if none.

    A pattern earlier in the list wins over one earlier in the text. A text is
    searched once for each pattern up to that; its parts are taken from the match.
    """
    ends = F.create_map(*(F.lit(x) for pair in PERIOD_ENDS.items() for x in pair))
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(DATES):

        def written(found: Column, pattern: str = pattern, kind: str = kind) -> Column:
            part = lambda i: F.regexp_extract(found, pattern, i)
            year = part(1)
            if kind == "period":
                return F.concat(year, F.lit("-"), F.coalesce(F.try_element_at(ends, part(2)), F.lit("12")))
            return F.concat_ws("-", year, *(F.lpad(part(i), 2, "0") for i in range(2, {"year": 2, "month": 3, "day": 4}[kind])))

        match = F.array(F.regexp_extract(text, pattern, 0))
        out = F.coalesce(F.transform(match, lambda m: F.when(m != "", written(m)))[0], out)
    return out


#: Words up to which a mapping becomes an expression; more are looked for by one automaton.
FEW_WORDS = 24


def longest_keyword(text: Column, names: Mapping[str, str]) -> Column:
    """The name of the longest keyword that occurs; of equally long ones, the first in order of code points."""
    if len(names) > FEW_WORDS:
        return matching.longest(matching.mapping_matcher(SparkSession.active(), names)(text))
    out = F.lit(None).cast("string")
    for word in sorted(names, key=lambda w: (-len(w), w), reverse=True):
        out = F.when(F.contains(text, F.lit(word)), F.lit(names[word])).otherwise(out)
    return out


def sector_votes(text: Column, sectors: Mapping[str, list[str]]) -> Column:
    """The sector with most keywords in the text, the first declared of equals; null without any."""
    best = F.array_max(F.array(*(F.struct(distinct_hits(text, words).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(sectors.items()))))
    return F.when(best["n"] > 0, best["name"])


def metrics(text: Column, patterns: Mapping[str, str] = METRICS) -> Column:
    """An array of struct(metric, value, unit) of the patterns that occur; ``万`` cards are counted out."""
    each = []
    for name, p in patterns.items():
        value = F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
        factor, unit = F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3)
        cards = unit == "卡"
        found = F.struct(F.lit(name).alias("metric"), F.when(cards & (factor == "万"), value * 10000).otherwise(value).alias("value"), F.when(cards, unit).otherwise(F.concat(factor, unit)).alias("unit"))
        each.append(F.when(text.rlike(p), found))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def rename_metrics(found: Column, aliases: Mapping[str, list[str]]) -> Column:
    """A map of metrics with known keys renamed, by the first alias of each that occurs; unknown keys stay."""
    known = {a for names in aliases.values() for a in names}
    named = [F.when(F.coalesce(*(F.try_element_at(found, F.lit(a)) for a in names)).isNotNull(), F.struct(F.lit(to).alias("key"), F.coalesce(*(F.try_element_at(found, F.lit(a)) for a in names)).alias("value"))) for to, names in aliases.items()]
    taken = [F.lit(k) for k in {*known, *aliases}]
    rest = F.map_filter(found, lambda k, v: ~k.isin(*taken))
    return F.map_concat(rest, F.map_from_entries(F.filter(F.array(*named), lambda x: x.isNotNull())))


def companies(text: Column, min_chars: int = 4) -> Column:
    """Names that end as companies do, distinct, in the order of the text."""
    return pattern_entities(text, COMPANY, min_chars)


def amounts(text: Column) -> Column:
    """Sums of money: an array of struct(value, unit), in the order of the text."""
    each = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), 0)
    part = lambda x, i: F.regexp_extract(x, MONEY, i)
    return F.transform(each, lambda x: F.struct(F.regexp_replace(part(x, 1), ",", "").try_cast("double").alias("value"), F.concat(part(x, 2), part(x, 3)).alias("unit")))


def currency(text: Column) -> Column:
    return F.when(text.rlike("美元|USD"), "USD").when(text.rlike("港元|HKD"), "HKD").otherwise("CNY")


def search_queries(metric_names: Column, company_names: Column, labels: Mapping[str, str], general: list[str]) -> Column:
    """Up to three queries: one for the first labelled metric, one for the first company, else general ones."""
    known = F.array(*(F.when(F.array_contains(metric_names, k), F.lit(f"{label} 分析")) for k, label in labels.items()))
    first = F.slice(F.filter(known, lambda x: x.isNotNull()), 1, 1)
    company = F.filter(F.transform(F.slice(company_names, 1, 1), lambda x: F.concat(x, F.lit(" 业务进展"))), lambda x: x.isNotNull() & (x != " 业务进展"))
    found = F.concat(first, company)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*(F.lit(g) for g in general[:3])))


def normalised_type(doc_type: Column, source: Column) -> Column:
    """Names of older stores in today's; a conclusion that was stored (source ``analysis:…``) has its own; else as it is."""
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    empty = F.coalesce(doc_type, F.lit("")) == ""
    return F.coalesce(F.try_element_at(names, doc_type), F.when(empty & F.coalesce(source, F.lit("")).startswith("analysis:"), "analysis"), doc_type)


def normalised_date(publish_date: Column, publish_time: Column) -> Column:
    """The day of a full time stamp wins over the date that stands in the text."""
    return F.when(F.coalesce(publish_time, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(publish_time, 1, 10)).otherwise(publish_date)


def confidence(text: Column) -> Column:
    """high, low or medium as the text states it, in this order; empty if it does not."""
    out = F.lit("")
    for name, pattern in reversed(CONFIDENCE):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def section(text: Column, name: str) -> Column:
    """What stands under the heading 【name】, up to the next one; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)【{name}】(.*?)(?:【|$)", 1))


def section_items(text: Column, name: str) -> Column:
    """The lines of a section without their bullets, blank ones left out."""
    lines = F.transform(F.split(section(text, name), "\n"), lambda x: F.regexp_replace(x, r"^\s*[-•·]*\s*|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def heuristic_verdict(text: Column, bullish: str, bearish: str, growth: Column | None = None, strong: float = 20.0) -> Column:
    """Matches of two patterns, all of them, and growths beyond ``strong`` percent either way: over 1 bullish, under -1 bearish."""
    score = F.regexp_count(text, F.lit(bullish)) - F.regexp_count(text, F.lit(bearish))
    if growth is not None:
        score = score + F.size(F.filter(growth, lambda g: g > strong)) - F.size(F.filter(growth, lambda g: g < -strong))
    return F.when(score > 1, "bullish").when(score < -1, "bearish").otherwise("neutral")


def assessment_problems(verdict: Column, stated: Column, signals: Column, source: Column, verdicts: list[str], levels: list[str]) -> Column:
    """struct(errors, warnings) of an assessment; signals are array<struct<signal, severity, evidence>>.

    Errors: a verdict or confidence outside its list. Warnings: fewer than two
    or more than four signals, a severity outside 1 to 5, evidence that is not in
    the source word for word (empty evidence and the knowledge base's are exempt).
    """
    errors = F.array(F.when(~F.coalesce(verdict.isin(verdicts), F.lit(False)), "verdict"), F.when(~F.coalesce(stated.isin(levels), F.lit(False)), "confidence"))
    bad = F.transform(signals, lambda x, i: F.when(~F.coalesce(x["severity"].between(1, 5), F.lit(False)), F.concat(F.lit("severity "), i.cast("string"))))
    bare = lambda x: F.trim(F.coalesce(x["evidence"], F.lit("")))
    unfounded = lambda x: (bare(x) != "") & ~bare(x).rlike("^知识库[:：]") & ~F.contains(F.coalesce(source, F.lit("")), bare(x))
    loose = F.transform(signals, lambda x, i: F.when(unfounded(x), F.concat(F.lit("evidence "), i.cast("string"))))
    count = F.array(F.when(~F.size(signals).between(2, 4), "signals"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return F.struct(some(errors).alias("errors"), some(F.concat(count, bad, loose)).alias("warnings"))


def extraction_quality(metric_names: Column, categories: list[Column], expected: list[str]) -> Column:
    """0.6 of the share of expected metrics, 0.4 of the filled categories, four of which are enough."""
    hit = F.size(F.array_intersect(metric_names, F.array(*(F.lit(m) for m in expected)))) / len(expected)
    filled = sum(((F.size(c) > 0).cast("int") for c in categories), F.lit(0))
    return F.round(0.6 * hit + 0.4 * F.least(filled / 4, F.lit(1.0)), 4)


def query_quality(queries: Column) -> Column:
    """0.4 for three queries or the part of them, 0.6 for different lengths (0.36 for equal ones); 0 without any."""
    lengths = F.array_distinct(F.transform(queries, F.length))
    return F.when(F.size(queries) == 0, 0.0).otherwise(F.round(0.4 * F.least(F.size(queries) / 3, F.lit(1.0)) + 0.6 * F.when(F.size(lengths) > 1, 1.0).otherwise(0.6), 4))


def pattern_entities(text: Column, pattern: str, min_chars: int = 4) -> Column:
    """Distinct matches of at least ``min_chars`` characters, in the order of the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= min_chars))


def sentiment(title: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """positive, negative or neutral, by which list has more distinct words in the title."""
    up, down = distinct_hits(title, positive or POSITIVE), distinct_hits(title, negative or NEGATIVE)
    return F.when(up > down, F.lit("positive")).when(down > up, F.lit("negative")).otherwise(F.lit("neutral"))


def event_impact(text: Column, bullish: str, bearish: str) -> Column:
    """struct(direction, factor): matches of two patterns; factor is 3 plus the hits, at most 10, or 2."""
    up, down = F.regexp_count(text, F.lit(bullish)), F.regexp_count(text, F.lit(bearish))
    side = F.when(up > down, F.lit("bullish")).when(down > up, F.lit("bearish")).otherwise(F.lit("neutral"))
    return F.struct(side.alias("direction"), F.when(up == down, F.lit(2)).otherwise(F.least(F.lit(10), F.greatest(up, down) + 3)).cast("int").alias("factor"))


def last_mentioned(text: Column, verdicts: Mapping[str, str], default: str = "neutral") -> Column:
    """The verdict whose keyword is mentioned last."""
    reversed_text = F.reverse(text)
    places = [F.struct((F.length(text) - F.instr(reversed_text, w[::-1])).alias("at"), F.lit(w).alias("word"), F.lit(v).alias("verdict"), (F.instr(reversed_text, w[::-1]) > 0).alias("found")) for w, v in verdicts.items()]
    found = F.filter(F.array(*places), lambda x: x["found"])
    return F.coalesce(F.array_max(found)["verdict"], F.lit(default))


def completeness(columns: list[Column]) -> Column:
    """The share of fields that are neither null nor empty."""
    return F.round(sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0)) / len(columns), 4)


def metadata_completeness(docs: DataFrame, meta: str | None = "meta", fields: tuple[str, ...] = METADATA_FIELDS) -> Column:
    """The share of ``fields`` that a row has, as a column or else as a key of the map ``meta``; null, empty and the number zero are missing."""
    kinds = dict(docs.dtypes)

    def filled(name: str) -> Column:
        if name in kinds:
            return F.nullif(F.col(name).cast("string"), F.lit("" if kinds[name] == "string" else "0"))
        return F.nullif(F.try_element_at(F.col(meta), F.lit(name)), F.lit("")) if meta in kinds else F.lit(None).cast("string")

    return completeness([filled(name) for name in fields])


def fiscal_period(text: Column) -> Column:
    """YYYYQn or YYYYHn, halves mapped to their own period; null if none."""
    half, quarter = r"(\d{4})\s*年?\s*H([12])", r"(\d{4})\s*年?\s*Q([1-4])"
    return F.when(text.rlike(half), F.concat(F.regexp_extract(text, half, 1), F.lit("H"), F.regexp_extract(text, half, 2))).when(text.rlike(quarter), F.concat(F.regexp_extract(text, quarter, 1), F.lit("Q"), F.regexp_extract(text, quarter, 2)))


def stock_code(text: Column, names: Mapping[str, str] | None = None) -> Column:
    """The code of a known name, else isolated six digits with their exchange; null if none."""
    digits = F.regexp_extract(text, r"(?<!\d)(\d{6})(?!\d)", 1)
    code = F.when(digits == "", None).when(digits.startswith("6"), F.concat(digits, F.lit(".SH"))).when(digits.rlike("^[03]"), F.concat(digits, F.lit(".SZ"))).otherwise(digits)
    if len(names or {}) > FEW_WORDS:
        return F.coalesce(matching.first_declared(matching.mapping_matcher(SparkSession.active(), names)(text)), code)
    for name, known in reversed(list((names or {}).items())):
        code = F.when(F.contains(text, F.lit(name)), F.lit(known)).otherwise(code)
    return code
