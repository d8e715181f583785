"""Metadata filters, gates and keyword classifiers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import CJK, distinct_hits

_COMPARE = {
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "ne": lambda c, v: c != v,
    "eq": lambda c, v: c == v,
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "regex": lambda c, v: c.rlike(v),
}


def metadata_filter(filters: Mapping[str, Any], soft: frozenset[str] = frozenset()) -> Column:
    """A filter tree as a predicate that is never null.

    Keys are joined by AND. A value is matched by equality, a list by
    membership, a mapping by its operators (with or without ``$``; an unknown
    one is ignored). ``$not`` negates a tree, ``$exists`` and ``$not_exists``
    test fields. A missing field fails every condition on it, ``$ne`` too,
    unless its key is soft: then it passes.
    """
    out = F.lit(True)
    for key, wanted in filters.items():
        name = key.lstrip("$")
        if name == "not" and key != name:
            out = out & ~metadata_filter(wanted, soft)
        elif name in ("exists", "not_exists") and key != name:
            for field in [wanted] if isinstance(wanted, str) else wanted:
                out = out & (F.col(field).isNotNull() if name == "exists" else F.col(field).isNull())
        else:
            for test in _leaf(F.col(key), wanted):
                out = out & F.coalesce(test, F.lit(key in soft))
    return out


def _leaf(column: Column, wanted: Any) -> list[Column]:
    if isinstance(wanted, Mapping):
        return [_COMPARE[op.lstrip("$")](column, value) for op, value in wanted.items() if op.lstrip("$") in _COMPARE]
    if isinstance(wanted, (list, tuple, set)):
        return [column.isin(list(wanted))]
    return [column == wanted]


def relevance_gate(text: Column, words: list[str], script: str = CJK, min_chars: int = 20, min_share: float = 0.1) -> Column:
    """struct(passed, reason, hits): long enough, enough of the script, and a domain word."""
    # Runs of the script are taken out at once, which is far cheaper than to count their characters.
    rest = F.length(F.regexp_replace(text, f"(?:{script})+", ""))
    share = (F.length(text) - rest) / F.greatest(F.length(text), F.lit(1))
    hits = distinct_hits(F.lower(text), words)
    reason = (
        F.when(F.coalesce(F.length(text), F.lit(0)) < min_chars, F.lit("too_short"))
        .when(share < min_share, F.lit("script"))
        .when(hits == 0, F.lit("no_keyword"))
    )
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), F.coalesce(hits, F.lit(0)).alias("hits"))


def document_detector(text: Column, rules: list[tuple[str, list[str] | str, int]], other: str = "other", least_chars: int = 100, long: str | None = None) -> Column:
    """The first label whose rule holds, in order.

    A rule (label, words, least) asks for so many distinct words, a rule
    (label, pattern, 1) for a match. Words are found without overlap, the longest
    first, so a word within a longer one is not counted. Without any, a text of
    more than ``least_chars`` characters is ``long``, if that is given.
    """
    words = sorted({w for _, rule, _ in rules if not isinstance(rule, str) for w in rule}, key=lambda w: (-len(w), w))
    pattern = "|".join(re.escape(w) for w in words)
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)) if words else F.array().cast("array<string>")

    def label(hits: Column) -> Column:
        out = F.when(F.length(text) > least_chars, long).otherwise(other) if long else F.lit(other)
        for name, rule, least in reversed(rules):
            holds = text.rlike(rule) if isinstance(rule, str) else F.size(F.array_intersect(hits, F.array(*(F.lit(w) for w in rule)))) >= least
            out = F.when(holds, F.lit(name)).otherwise(out)
        return out

    # The hits are a lambda's argument, so that the text is searched for words once.
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", other).otherwise(F.transform(F.array(found), label)[0])


def filter_report(rows: DataFrame, filters: Mapping[str, Any], soft: frozenset[str] = frozenset()) -> DataFrame:
    """(condition, n_rows, n_passed): each key of a filter tree on its own, and all of them as ``all``; one pass."""
    tests = {key: metadata_filter({key: wanted}, soft) for key, wanted in filters.items()} | {"all": metadata_filter(filters, soft)}
    names = list(tests)
    counts = rows.agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(tests[name].cast("long")), F.lit(0)).alias(f"c{i}") for i, name in enumerate(names)))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("condition"), F.col(f"c{i}").cast("long").alias("n_passed")) for i, name in enumerate(names))))
    return counts.select("n_rows", each.alias("x")).select("x.condition", "n_rows", "x.n_passed")


def keyword_class(text: Column, words: Mapping[str, list[str]], other: str = "other", patterns: Mapping[str, str] | None = None) -> Column:
    """struct(label, confidence): the class with most distinct keywords; the first declared of equals.

    A class's pattern, if it has one and it matches, counts as one more.
    Confidence is a third per keyword, at most one.
    """
    order = list(words)
    matched = lambda k: F.coalesce(text.rlike(patterns[k]).cast("int"), F.lit(0)) if patterns and k in patterns else F.lit(0)
    counts = F.array(*(F.struct((distinct_hits(text, words[k]) + matched(k)).alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, k in enumerate(order)))
    best = F.array_max(counts)
    found = best["n"] > 0
    return F.struct(F.when(found, best["label"]).otherwise(F.lit(other)).alias("label"), F.when(found, F.round(F.least(F.lit(1.0), best["n"] / 3), 4)).otherwise(F.lit(0.0)).alias("confidence"))


def intent_class(text: Column, intents: Mapping[str, tuple[list[str], list[str]]], default: str = "general") -> Column:
    """struct(intent, score): 0.3 per keyword and 0.4 per pattern, at most one; the first maximum wins."""
    scored = []
    for i, (name, (words, patterns)) in enumerate(intents.items()):
        points = distinct_hits(F.lower(text), words) * 0.3
        for p in patterns:
            points = points + text.rlike(p).cast("int") * 0.4
        scored.append(F.struct(F.round(F.least(F.lit(1.0), points), 4).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("intent")))
    best = F.array_max(F.array(*scored))
    return F.struct(F.when(best["score"] > 0, best["intent"]).otherwise(F.lit(default)).alias("intent"), F.when(best["score"] > 0, best["score"]).otherwise(F.lit(0.5)).alias("score"))


#: Lower limits of A to D for answer checks.
GUARD_BANDS = (0.9, 0.8, 0.65, 0.5)


def grade(score: Column, bands: tuple[float, ...] = (0.9, 0.75, 0.6, 0.4), names: str = "ABCDF") -> Column:
    """The letter of the highest band that ``score`` reaches."""
    out = F.lit(names[-1])
    for low, name in reversed(list(zip(bands, names, strict=False))):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def keyword_filter(text: Column, keywords: str) -> Column:
    """Whether any part of ``keywords`` (split at commas, two characters or more) occurs; none: all pass."""
    parts = [p.strip() for p in keywords.replace("，", ",").replace("、", ",").split(",")]
    parts = [p for p in parts if len(p) >= 2]
    return F.lit(True) if not parts else F.coalesce(distinct_hits(text, parts) > 0, F.lit(False))
