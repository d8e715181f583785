"""Answer verification against several sources, as joins; every score comes from rules and can be explained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import GUARD_BANDS, grade
from . import evaluation as rules


Words = Callable[[Column], Column]


def _anchored(answers: DataFrame, sources: DataFrame, keys: list[str], words: Words, share: float) -> DataFrame:
    """(keys, n_sentences, n_anchored, loose): a sentence is anchored if one source has enough of its words, or it has fewer than two.

    Sentences meet the sources of their own answer only, and a maximum over
    them is what is kept.
    """
    each = answers.select(*keys, F.posexplode(rules.sentences(F.col("answer"))).alias("at", "sentence"))
    each = each.withColumn("words", F.array_distinct(words(F.col("sentence"))))
    known = sources.select(*keys, words(F.col("text")).alias("known"))
    met = each.where(F.size("words") >= 2).join(known, keys)
    best = met.groupBy(*keys, "at").agg(F.max(F.size(F.array_intersect("words", "known")) / F.size("words")).alias("best"))
    rows = each.join(best, [*keys, "at"], "left")
    good = (F.size("words") < 2) | (F.coalesce("best", F.lit(0.0)) >= share)
    loose = F.transform(F.array_sort(F.collect_list(F.when(~good, F.struct("at", F.substring("sentence", 1, 80).alias("x"))))), lambda s: s["x"])
    return rows.groupBy(*keys).agg(F.count("*").alias("n_sentences"), F.sum(good.cast("long")).alias("n_anchored"), loose.alias("loose"))


def _verified(answers: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_numbers, n_verified, unmatched): numbers of the answer, repeats included, that some source has."""
    each = answers.select(*keys, F.posexplode(rules.numbers(F.col("answer"))).alias("at", "number"))
    known = sources.select(*keys, F.explode(rules.numbers(F.col("text"))).alias("number")).distinct().withColumn("known", F.lit(True))
    rows = each.join(known, [*keys, "number"], "left")
    missing = F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("at", "number")))), lambda s: s["number"])
    return rows.groupBy(*keys).agg(F.count("*").alias("n_numbers"), F.count("known").alias("n_verified"), F.slice(missing, 1, 5).alias("unmatched"))


def check(answers: DataFrame, sources: DataFrame, keys: list[str], stop: list[str], mode: str = "rag", share: float = rules.GROUNDED_SHARE, patterns: list[str] | None = None, threshold: float = 0.6, words: Words | None = None) -> DataFrame:
    """One row per answer (keys, answer), against its sources (keys, text).

    Columns: keys, skipped, skip_reason (empty_answer or no_sources), grounding,
    numbers, citations, structure, overall, passed, risk, grade, n_unanchored,
    unanchored, unmatched, and the counts behind the scores. Sources without text
    are none. A skipped answer has no scores and the risk ``unknown``: not checked
    is not zero. ``mode`` is ``rag`` or ``analysis``; keys are unique. ``words``
    gives the words of answers and sources alike, for Chinese a ``segmenter`` with
    words of two characters or more; without it they are ``content_words``.
    """
    sources = sources.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    counts = sources.groupBy(*keys).agg(F.count("*").alias("n_sources"))
    rows = answers.select(*keys, "answer").join(counts, keys, "left")
    rows = rows.join(_anchored(answers, sources, keys, words or (lambda c: rules.content_words(c, stop)), share), keys, "left").join(_verified(answers, sources, keys), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    part = lambda a, b: F.coalesce(F.round(F.col(a) / F.col(b), 4), F.lit(1.0))
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    reason = F.when(blank, "empty_answer").when(F.col("n_sources").isNull(), "no_sources")
    rows = rows.select(
        *keys,
        reason.isNotNull().alias("skipped"),
        reason.alias("skip_reason"),
        part("n_anchored", "n_sentences").alias("grounding"),
        part("n_verified", "n_numbers").alias("numbers"),
        rules.citation_integrity(F.col("answer"), zero(F.col("n_sources")), mode).alias("citations"),
        rules.structure(F.col("answer"), patterns or rules.SECTIONS[mode]).alias("structure"),
        F.size(F.coalesce("loose", F.array().cast("array<string>"))).alias("n_unanchored"),
        F.col("loose").alias("unanchored"),
        "unmatched",
        *(zero(F.col(c)).alias(c) for c in ("n_sources", "n_sentences", "n_anchored", "n_numbers", "n_verified")),
    )
    rows = rows.withColumn("overall", rules.overall({k: F.col(k) for k in rules.LAYERS}))
    told = ~F.col("skipped")
    rows = rows.withColumn("passed", told & (F.col("overall") >= threshold))
    rows = rows.withColumn("risk", F.when(told, rules.risk(F.col("overall"), F.col("n_unanchored"))).otherwise("unknown"))
    rows = rows.withColumn("grade", F.when(told, grade(F.col("overall"), GUARD_BANDS)))
    return rows.withColumns({c: F.when(told, F.col(c)) for c in (*rules.LAYERS, "overall")})


def precheck(checked: DataFrame) -> DataFrame:
    """``checked`` with quick_score, 0.6 of the grounding and 0.4 of the numbers, and a warning under 0.5."""
    quick = F.round(0.6 * F.col("grounding") + 0.4 * F.col("numbers"), 4)
    return checked.withColumn("quick_score", quick).withColumn("warning", F.coalesce(quick < 0.5, F.lit(False)))


def serialised() -> Column:
    """The result of ``check`` as JSON: scores to three decimals, layers with what may leave the house."""
    layer = lambda name, *more: F.struct(F.round(name, 3).alias("score"), *more)
    told = ~F.col("skipped")
    layers = F.struct(
        layer("grounding", F.col("n_anchored").alias("anchored"), F.col("n_sentences").alias("total"), F.col("unanchored")).alias("grounding"),
        layer("numbers", F.col("n_verified").alias("verified"), F.col("n_numbers").alias("total"), F.col("unmatched")).alias("numbers"),
        layer("citations").alias("citations"),
        layer("structure").alias("structure"),
    )
    return F.to_json(F.struct("skipped", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), F.coalesce(F.round("overall", 3), F.lit(0.0)).alias("overall_score"), "risk", "passed", F.when(told, layers).alias("layers")))


def report_text() -> Column:
    """The result of ``check`` as a few lines for readers; empty if it was skipped."""
    line = lambda name, tail: F.concat(F.lit(f"- {name}: "), F.format_string("%.0f%%", F.col(name) * 100), tail)
    of = lambda a, b: F.format_string(" (%d/%d)", F.col(a), F.col(b))
    head = F.concat(F.lit("Quality: "), F.col("grade"), F.format_string(" (%.0f%%)", F.col("overall") * 100))
    loose = F.transform(F.slice("unanchored", 1, 3), lambda s: F.concat(F.lit("  - no source: "), s))
    missing = F.when(F.size("unmatched") > 0, F.concat(F.lit("  - numbers without source: "), F.array_join(F.slice("unmatched", 1, 3), ", ")))
    lines = F.concat(F.array(head, line("grounding", of("n_anchored", "n_sentences")), line("numbers", of("n_verified", "n_numbers")), line("citations", F.lit("")), line("structure", F.lit(""))), F.coalesce(loose, F.array().cast("array<string>")), F.array(missing))
    return F.when(F.col("skipped"), "").otherwise(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
