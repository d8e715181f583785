"""Text cleaning as a chain of column expressions; the order of steps matters.

All steps but Unicode normalisation are built-in expressions and stay in the
JVM. A null text stays null, an empty one empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import share_package

# The patterns of each step.
TAG = r"<[^>]+>"
URL_SIGNS = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
URL = rf"https?://{URL_SIGNS}|www\.{URL_SIGNS}"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
REPEATED = r"([^\d])\1{4,}"
BOILERPLATE = ("版权", "copyright", "关注", "微信", "公众号", "扫码", "二维码", "点击阅读原文", "免责声明", "转载", "来源", "编辑", "责编", "版权与免责声明", "all rights reserved", "disclaimer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def strip_urls(text: Column) -> Column:
    """Only characters that a URL can have, so text written straight after it survives."""
    return F.regexp_replace(text, URL, "")


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


@F.pandas_udf(StringType())
def normalize_nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no expression."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def strip_control(text: Column) -> Column:
    """Control characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROL, "")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def collapse_repeated(text: Column) -> Column:
    """Five or more of one character become three; digits stay."""
    return F.regexp_replace(text, REPEATED, "$1$1$1")


def drop_boilerplate(text: Column, words: tuple[str, ...] = BOILERPLATE, around: int = 20) -> Column:
    """Lines in which a keyword has at most ``around`` characters on each side."""
    pattern = "(?i)^.{0,%d}(%s).{0,%d}$" % (around, "|".join(words), around)
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(pattern)), "\n")


def collapse_whitespace(text: Column) -> Column:
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.regexp_replace(out, r"([，。！？；：])[ \t]+", "$1")


def dedup_paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """The first of equal paragraphs stays; blank ones all stay. In time n log n: equals are neighbours once sorted."""
    rows = F.array_sort(F.transform(F.split(text, separator, -1), lambda x, i: F.struct(strip(x).alias("bare"), i.alias("at"), x.alias("whole"))))
    before = lambda s: F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda x: x["bare"]))
    # The sorted array is a lambda's argument, so that it is made once.
    kept = F.transform(F.array(rows), lambda s: F.zip_with(s, F.slice(before(s), F.lit(1), F.size(s)), lambda x, last: F.when((x["bare"] == "") | last.isNull() | (last != x["bare"]), F.struct(x["at"].alias("at"), x["whole"].alias("whole")))))[0]
    return F.when(text.isNotNull(), F.array_join(F.transform(F.array_sort(F.filter(kept, lambda x: x.isNotNull())), lambda x: x["whole"]), separator))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$", "")


STEPS = {
    "html": strip_tags,
    "urls": strip_urls,
    "emails": strip_emails,
    "unicode": normalize_nfkc,
    "control": strip_control,
    "zero_width": strip_zero_width,
    "repeats": collapse_repeated,
    "boilerplate": drop_boilerplate,
    "whitespace": collapse_whitespace,
    "paragraphs": dedup_paragraphs,
    "strip": strip,
}


def clean(text: Column, steps: tuple[str, ...] = tuple(STEPS)) -> Column:
    """The chosen steps, always in their fixed order."""
    for name, step in STEPS.items():
        if name in steps:
            text = step(text)
    return text


def clean_frame(rows: DataFrame, text: str, out: str, steps: tuple[str, ...] = tuple(STEPS)) -> DataFrame:
    """``rows`` with the cleaned text in column ``out``.

    The Python step is projected on its own: Spark does not take its result
    within the lambdas of the steps that follow.
    """
    share_package(rows.sparkSession)
    order = list(STEPS)
    at = order.index("unicode") + 1
    rows = rows.withColumn(out, clean(F.col(text), tuple(s for s in order[:at] if s in steps)))
    return rows.withColumn(out, clean(F.col(out), tuple(s for s in order[at:] if s in steps)))


def clean_statistics(raw: Column, cleaned: Column) -> list[Column]:
    """retention, over_cleaned (under 0.3 but something left) and emptied."""
    before, after = F.length(raw), F.length(cleaned)
    kept = F.when(before > 0, after / before).otherwise(F.lit(1.0))
    return [F.round(kept, 4).alias("retention"), ((kept > 0) & (kept < 0.3)).alias("over_cleaned"), ((before > 0) & (after == 0)).alias("emptied")]


def strip_news_html(text: Column) -> Column:
    """Tags and the five common entities; ``&amp;`` last, so that nothing is decoded twice."""
    out = strip_tags(text)
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return strip(out)
