"""Slots of templates: cleaning of values, their scores, and rendering."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What models say before a value, what they say when they do not know, and quotes in pairs.
PREFIXES = ("好的，", "根据参考信息，", "综上所述，", "分析如下：", "以下是", "回答：", "答案是", "根据以上信息，", "OK，", "好的。", "根据您提供的信息，")
NOTHING = ("无", "无。", "N/A")
UNSURE = ("无法确定", "没有足够信息", "我不知道", "无法判断", "抱歉", "对不起", "信息不足")
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))


def clean_slot(value: Column, prefixes: tuple[str, ...] = PREFIXES, default: str = "") -> Column:
    """Without up to three prefixes and one pair of quotes; the default for null and empty."""
    head = "|".join(re.escape(p) for p in prefixes)
    bare = F.regexp_replace(F.trim(value), rf"^(?:(?:{head})\s*){{1,3}}", "")
    bare = F.trim(bare)
    out = bare
    for left, right in reversed(QUOTES):
        out = F.when(bare.startswith(left) & bare.endswith(right) & (F.length(bare) > 2), F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(out)
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(out)


def slot_score(value: Column, grounding: Column | None = None, least: int = 3, most: int = 600) -> Column:
    """0 for nothing, 0.6 for an honest refusal, else 1 less 0.5 if too short, 0.2 if too long, and 0.4 for a number that the grounding lacks.

    Without grounding text numbers cost nothing.
    """
    off = F.when(F.length(value) < least, 0.5).otherwise(0.0) + F.when(F.length(value) > most, 0.2).otherwise(0.0)
    if grounding is not None:
        known = F.coalesce(grounding, F.lit(""))
        made_up = F.exists(F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), 0), lambda n: ~F.contains(known, n))
        off = off + F.when((known != "") & made_up, 0.4).otherwise(0.0)
    honest = F.trim(value).isin(*NOTHING) | value.rlike("|".join(UNSURE))
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).when(honest, 0.6).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - off), 2))


def render(template: str, values: Mapping[str, Column], labels: Mapping[str, str]) -> Column:
    """The template with its ``{key}`` filled; an empty or unknown one says that it is missing."""
    out = F.lit(template)
    for key, label in labels.items():
        value = values.get(key, F.lit(None).cast("string"))
        out = F.replace(out, F.lit("{" + key + "}"), F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(f"（{label}暂缺）"))
    return F.trim(out)
