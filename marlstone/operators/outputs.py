"""Evaluation of templated outputs: filled fields, combined quality, tiers, and calibration of injected judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the parts of output quality, and what a template writes for a field it could not fill.
QUALITY = {"numbers": 0.4, "grounding": 0.3, "completeness": 0.3}
PLACEHOLDER = r"（.*暂缺）"
# The fields of each template and where they stand in its output.
TEMPLATES = {
    "news_brief": {
        "event_title": r"(?m)^##\s*📰\s*(.+?)\s*$",
        "event_date": r"\*\*时间\*\*:\s*([^|\n]+)",
        "impact_level": r"\*\*影响\*\*:\s*([^\n]+)",
        "key_players": r"\*\*涉及\*\*:\s*([^\n]+)",
        "sector_impact": r"\*\*行业\*\*:\s*([^\n]+)",
        "market_reaction": r"\*\*市场\*\*:\s*([^\n]+)",
        "outlook": r"\*\*展望\*\*:\s*([^\n]+)",
    },
    "quick_qa": {
        "direct_answer": r"(?s)###\s*回答\s*\n(.*?)(?=\n\*\*|\z)",
        "supporting_data": r"\*\*数据支撑\*\*:\s*([^\n]+)",
        "source_note": r"\*\*来源\*\*:\s*([^\n]+)",
        "confidence_note": r"\*\*可信度\*\*:\s*([^\n]+)",
    },
    "deep_analysis": {
        name: rf"(?s)###\s*{label}\s*\n(.*?)(?=\n###\s|\z)"
        for name, label in (("executive_summary", "摘要"), ("profitability", "盈利能力"), ("growth", "成长性"), ("health", "财务健康度"), ("valuation_hint", "估值参考"), ("recommendation", "投资建议"))
    },
}


def filled_fields(text: Column, fields: dict[str, str]) -> Column:
    """struct(score, filled, missing): fields whose pattern finds a value that is neither blank nor a placeholder."""
    values = F.array(*(F.struct(F.lit(name).alias("name"), F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)).alias("value")) for name, pattern in fields.items()))
    good = lambda x: (x["value"] != "") & ~x["value"].rlike(PLACEHOLDER)
    missing = F.transform(F.filter(values, lambda x: ~good(x)), lambda x: x["name"])
    count = F.size(F.filter(values, good))
    return F.struct(F.round(count / len(fields), 4).alias("score"), count.alias("filled"), missing.alias("missing"))


def claims(text: Column, fields: dict[str, str]) -> Column:
    """The filled values of a template's fields, which are what a judge checks."""
    values = F.array(*(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)) for pattern in fields.values()))
    return F.filter(values, lambda v: (v != "") & ~v.rlike(PLACEHOLDER))


def output_quality(numbers: Column, grounding: Column, completeness: Column) -> Column:
    return F.round(QUALITY["numbers"] * numbers + QUALITY["grounding"] * grounding + QUALITY["completeness"] * completeness, 4)


def tier_means(cases: DataFrame, metrics: list[str], by: str = "tier") -> DataFrame:
    """(by, n_cases, means) of cases with a label; an array of labels counts each of them."""
    rows = cases.withColumn(by, F.explode(by)) if dict(cases.dtypes)[by].startswith("array") else cases
    return rows.groupBy(by).agg(F.count("*").alias("n_cases"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def separation(cases: DataFrame, metric: str = "output_quality", good: str = "good", bad: str = "bad") -> DataFrame:
    """One row (n_good, n_bad, good_mean, bad_mean, gap); means without cases are 0."""
    mean = lambda t: F.coalesce(F.avg(F.when(F.col("tier") == t, F.col(metric))), F.lit(0.0))
    count = lambda t: F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0).cast("long"))
    return cases.agg(count(good).alias("n_good"), count(bad).alias("n_bad"), F.round(mean(good), 6).alias("good_mean"), F.round(mean(bad), 6).alias("bad_mean"), F.round(mean(good) - mean(bad), 6).alias("gap"))


def floor_breaks(cases: DataFrame, floors: DataFrame, metric: str = "output_quality") -> DataFrame:
    """(case_id, floor, value) of pinned cases under their floor or gone; a floor has no tolerance."""
    rows = floors.join(cases.select("case_id", F.col(metric).alias("value")), "case_id", "left")
    return rows.where(F.col("value").isNull() | (F.col("value") < F.col("floor"))).select("case_id", "floor", "value")


def calibration(samples: DataFrame, defects: list[str], orthogonal: list[str], fabricated: str = "fabricated_number", least_gap: float = 0.1) -> DataFrame:
    """One row about a judge's scores: do they tell good samples from those with a defect?

    samples (case_id, tier, tags, score). Columns: means of good, bad, defective
    and orthogonally defective samples, gap, detection_rate (defective samples
    under 1), gap_ok, detection_ok, fabricated_ok. Means without samples are 0.
    """
    defect = F.arrays_overlap("tags", F.array(*(F.lit(t) for t in defects)))
    other = F.arrays_overlap("tags", F.array(*(F.lit(t) for t in orthogonal)))
    made_up = F.array_contains("tags", fabricated)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("score"))), F.lit(0.0))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    good = F.col("tier") == "good"
    found = samples.agg(
        mean(good).alias("good_mean"),
        mean(F.col("tier") == "bad").alias("bad_mean"),
        mean(defect).alias("defect_mean"),
        mean(other).alias("orthogonal_mean"),
        mean(made_up).alias("made_up"),
        count(made_up).alias("n_made_up"),
        count(defect).alias("n_defects"),
        count(defect & (F.col("score") >= 1)).alias("n_missed"),
    )
    gap = F.col("good_mean") - F.col("defect_mean")
    return found.select(
        *(F.round(c, 4).alias(c) for c in ("good_mean", "bad_mean", "defect_mean", "orthogonal_mean")),
        F.round(gap, 4).alias("gap"),
        F.round(F.when(F.col("n_defects") > 0, 1 - F.col("n_missed") / F.col("n_defects")).otherwise(0.0), 4).alias("detection_rate"),
        (gap >= least_gap).alias("gap_ok"),
        (F.col("n_missed") == 0).alias("detection_ok"),
        ((F.col("n_made_up") == 0) | (F.col("made_up") < F.col("good_mean"))).alias("fabricated_ok"),
    )
