"""Query understanding: type, dates, weighted keywords, expansion; JSON in free text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..staging import if_few
from .tokens import query_tokens

# Patterns of query types in order, and relative dates in days.
TYPES = (("comparison", r"对比|比较|vs|差异"), ("analysis", r"分析|为什么|原因|影响|怎么看"), ("factual", r"多少|是什么|什么时候|几"))
ABSOLUTE = (r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})[日号]?", r"(\d{4})(\d{2})(\d{2})")
PATTERNS = (
    (r"最近?一[周周]", 7),
    (r"最近?两[周周]", 14),
    (r"最近?半[月个]月?", 15),
    (r"[最]?近一[个月个]?月?", 30),
    (r"最近?三[月个]月?", 90),
    (r"[最]?近[一二两三四五七]天", 7),
    (r"上[周周]", 7),
    (r"上[月个]月?", 30),
)
#: Phrases beyond these patterns, looked for first.
RELATIVE = (("今天", 0), ("昨天", 1), ("近一周", 7), ("最近一周", 7), ("近一个月", 30), ("最近一个月", 30), ("近三个月", 90), ("近一年", 365))
DICTIONARY_WEIGHT = 2.0
EXPANSIONS = 10


def query_type(text: Column, types: tuple[tuple[str, str], ...] = TYPES) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(types):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def date_range(text: Column, as_of: Column) -> Column:
    """struct(gte, lte): an absolute date that exists, else the first relative phrase up to ``as_of``; nulls if neither."""
    low, high = F.lit(None).cast("date"), F.lit(None).cast("date")
    tests = [(F.contains(text, F.lit(p)), days) for p, days in RELATIVE] + [(text.rlike(p), days) for p, days in PATTERNS]
    for hit, days in reversed(tests):
        low, high = F.when(hit, F.date_sub(as_of, days)).otherwise(low), F.when(hit, as_of).otherwise(high)
    days = [F.concat_ws("-", F.regexp_extract(text, p, 1), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 3), 2, "0")).try_cast("date") for p in ABSOLUTE]
    day = F.coalesce(*days)
    return F.struct(F.coalesce(day, low).alias("gte"), F.coalesce(day, high).alias("lte"))


def in_range(day: Column, span: Column) -> Column:
    """Whether a row passes a parsed date: a soft filter, so rows without a date pass, as do all if none was parsed."""
    return span["gte"].isNull() | day.isNull() | F.coalesce(day.between(span["gte"], span["lte"]), F.lit(False))


def _segments(text: Column) -> Column:
    """Words, numbers and CJK runs in order; runs of two or more as bigrams, and whole up to six."""
    runs = F.regexp_extract_all(text, F.lit(r"[a-zA-Z]+|[\x{4e00}-\x{9fff}]+|\d+"), 0)
    cut = lambda r: F.concat(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))), F.when(F.length(r) <= 6, F.array(r)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"), cut(r)).otherwise(F.array(r))))


def weighted_keywords(text: Column, classes: list[tuple[str, float, list[str]]], stop: list[str]) -> Column:
    """Array of struct(term, weight, origin) in order: the words of each class that occur, then what is left of the text.

    A word of two classes has the first. The rest, without the words found and
    the stop words, gives tokens of two characters or more, weight 1 and origin
    ``residual``; they are what a dictionary does not know.
    """
    first: dict[str, tuple[float, str]] = {}
    for name, weight, words in classes:
        for w in words:
            first.setdefault(w, (float(weight), name))
    low = F.lower(F.coalesce(text, F.lit("")))
    entry = lambda w, x: F.struct(F.lit(w).alias("term"), F.lit(x[0]).alias("weight"), F.lit(x[1]).alias("origin"))
    known = F.filter(F.array(*(entry(w, x) for w, x in first.items())), lambda x: F.contains(low, F.lower(x["term"])))
    gone = sorted({w.lower() for w in first}, key=lambda w: (-len(w), w)) + [w.lower() for w in stop]
    rest = F.aggregate(F.array(*(F.lit(w) for w in gone)), low, lambda t, w: F.replace(t, w, F.lit(" "))) if gone else low
    tokens = F.filter(F.array_distinct(_segments(rest)), lambda t: (F.length(t) > 1) & ~t.isin([w.lower() for w in first] + stop))
    return F.concat(known, F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"), F.lit("residual").alias("origin"))))


def has_specific_intent(words: Column) -> Column:
    """Whether the query has a word that no dictionary knows."""
    return F.exists(words, lambda x: x["origin"] == "residual")


def index_query_tokens(text: Column, words: Column, least: float = 2.0) -> Column:
    """Tokens for a term search: those of the query, then dictionary words of enough weight, each once."""
    strong = F.transform(F.filter(words, lambda x: (x["weight"] >= least) & (x["origin"] != "residual")), lambda x: F.lower(x["term"]))
    return F.array_distinct(F.concat(query_tokens(text), strong))


def keywords(text: Column, weights: dict[str, float]) -> Column:
    """Distinct struct(term, weight) in order of terms: dictionary terms with their weight, other tokens with 1."""
    known = F.filter(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in sorted(weights.items()))), lambda x: F.contains(F.lower(text), x["term"]))
    rest = F.array_except(F.array_distinct(query_tokens(text)), F.transform(known, lambda x: x["term"]))
    return F.sort_array(F.concat(known, F.transform(rest, lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))))


def repeated_terms(words: Column) -> Column:
    """Terms repeated by their weight: at least once, three times at most."""
    return F.flatten(F.transform(words, lambda x: F.array_repeat(x["term"], F.least(F.lit(3), F.greatest(F.lit(1), x["weight"].cast("int"))))))


def expand(queries: DataFrame, synonyms: DataFrame, limit: int = EXPANSIONS, weight: float = 1.5, concepts: DataFrame | None = None, concept_weight: float = 0.6) -> DataFrame:
    """(query_id, term, weight): the other members of the groups of a query's terms, then concepts.

    queries (query_id, term) and, for concepts, specific (whether the query has
    an intent of its own); synonyms (term, group_id) and concepts (term, related)
    are dictionaries; they are counted, and broadcast if they are small. Related terms come only to queries without
    such an intent, which they would water down. At most ``limit`` terms per
    query, synonyms first, then in order of terms, none that the query has itself.
    """
    synonyms = if_few(synonyms)
    groups = queries.join(synonyms, "term").select("query_id", "group_id").distinct()
    found = groups.join(synonyms, "group_id").select("query_id", "term", F.lit(weight).alias("weight"))
    if concepts is not None:
        broad = queries.where("not specific").join(if_few(concepts), "term")
        found = found.unionByName(broad.select("query_id", F.col("related").alias("term"), F.lit(concept_weight).alias("weight")))
    found = found.groupBy("query_id", "term").agg(F.max("weight").alias("weight")).join(queries.select("query_id", "term"), ["query_id", "term"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("query_id", "term", "weight")


_BRACKET = re.compile(r"[{\[]")
_JSON = json.JSONDecoder(strict=False)


def _first_valid(text: str) -> str | None:
    """The valid object or list that begins first. Each bracket is a possible begin, also within quotes."""
    for bracket in _BRACKET.finditer(text):
        try:
            return text[bracket.start() : _JSON.raw_decode(text, bracket.start())[1]]
        except (ValueError, RecursionError):
            continue
    return None


def first_json(text: str | None) -> str | None:
    """The first JSON object or list in ``text``; a fenced block goes first; null if none is valid."""
    for part in (text or "").split("```")[1::2] + [text or ""]:
        if (found := _first_valid(part)) is not None:
            return found
    return None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """JSON is no regular language, so this one is Python."""
    return text.map(first_json)
