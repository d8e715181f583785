"""Tokenisers and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4E00}-\x{9FFF}]"


def index_tokens(text: Column) -> Column:
    """Tokens for an index: letters a-z, numbers with an optional %, and CJK runs.

    Runs of two to eight CJK characters stay whole, runs of four or more also
    give their trigrams. A null text has no tokens.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z]+"), 0)
    numbers = F.regexp_extract_all(low, F.lit(r"\d+(?:\.\d+)?%?"), 0)
    return F.concat(latin, _cjk_terms(low), numbers)


def index_terms(text: Column) -> Column:
    """The tokens of ``index_tokens`` in another order: one search of the text gives letters and numbers, and CJK is looked for only where there is any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_extract_all(low, F.lit(r"[a-z]+|\d+(?:\.\d+)?%?"), 0)
    return F.when(low.rlike(CJK), F.concat(plain, _cjk_terms(low))).otherwise(plain)


def _cjk_terms(low: Column) -> Column:
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), 0)
    whole = F.filter(runs, lambda r: F.length(r).between(2, 8))
    trigrams = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 4), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
    return F.concat(whole, trigrams)


def query_tokens(text: Column) -> Column:
    """Tokens of a query: as for the index, but CJK runs give bigrams, and are whole up to six."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z]+|\d+(?:\.\d+)?%?"), 0)
    runs = F.regexp_extract_all(low, F.lit(CJK + "{2,}"), 0)
    bigrams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, F.filter(runs, lambda r: F.length(r) <= 6), bigrams)


def estimate_tokens(text: Column) -> Column:
    """One token for each CJK character and one for every four others, rounded up."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.ceil((F.length(text) - cjk) / 4)).cast("long")


def distinct_hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``text``; the list is small and fixed."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)))
