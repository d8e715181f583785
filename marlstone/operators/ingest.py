"""The ingest chain: clean, check length, gate, classify, describe and route, with a reason for every rejection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cleaning, extraction, predicates
from ..functions.tokens import CJK
from . import knowledge


@dataclass(frozen=True)
class Rules:
    """What the chain accepts and how it describes it; all words and patterns are the caller's.

    ``kinds`` are the words of each document class, ``detector`` the rules that
    decide where fewer than ``sure`` of a class is found, ``pools`` the pool of
    each class, ``companies`` and ``sectors`` the dictionaries of metadata.
    """

    words: list[str]
    kinds: Mapping[str, list[str]]
    script: str = CJK
    min_chars: int = 80
    min_share: float = 0.1
    steps: tuple[str, ...] = tuple(cleaning.STEPS)
    detector: list[tuple[str, list[str] | str, int]] = field(default_factory=list)
    sure: float = 0.5
    pools: Mapping[str, str] = field(default_factory=dict)
    default_pool: str = "general"
    companies: Mapping[str, str] = field(default_factory=dict)
    sectors: Mapping[str, list[str]] = field(default_factory=dict)
    #: Characters of the text that metadata is looked for in, None for all.
    head: int | None = 500


def ingest(docs: DataFrame, rules: Rules, text: str = "text", title: str | None = None) -> DataFrame:
    """``docs`` with the cleaned text and what is known of it; batch or stream.

    New columns: reject_reason (empty, short, irrelevant or null), gate_reason,
    keywords, doc_type, confidence, pool, text_length, company, publish_date,
    sector. The last eight are null for rejected rows. A company, date, sector or
    doc_type that the rows already have, not empty, stays.
    """
    given = set(docs.columns)
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    rows = docs.withColumn("was_blank", blank)
    rows = cleaning.clean_frame(rows, text, text, rules.steps) if "unicode" in rules.steps else rows.withColumn(text, cleaning.clean(F.col(text), rules.steps))
    gate = predicates.relevance_gate(F.col(text), rules.words, rules.script, 0, rules.min_share)
    rows = rows.withColumn("gate", gate)
    short = F.length(cleaning.strip(F.coalesce(F.col(text), F.lit("")))) < rules.min_chars
    reason = F.when(F.col("was_blank"), "empty").when(short, "short").when(~F.col("gate.passed"), "irrelevant")
    rows = rows.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    rows = rows.withColumn("class", F.when(good, predicates.keyword_class(F.col(text), rules.kinds)))
    kind, sure = F.col("class.label"), F.col("class.confidence")
    if rules.detector:
        kind = F.when(sure < rules.sure, predicates.document_detector(F.col(text), rules.detector)).otherwise(kind)
    rows = rows.withColumn("found_type", F.when(good, _kept("doc_type", kind, given)))
    pool = F.lit(rules.default_pool)
    for name, to in rules.pools.items():
        pool = F.when(F.col("found_type") == name, to).otherwise(pool)
    seen = F.col(text) if rules.head is None else F.substring(F.col(text), 1, rules.head)
    seen = F.concat_ws("\n", F.col(title), seen) if title else seen
    described = {
        "company": extraction.longest_keyword(seen, rules.companies) if rules.companies else F.lit(None).cast("string"),
        "publish_date": extraction.publish_date(seen),
        "sector": extraction.sector_votes(seen, rules.sectors) if rules.sectors else F.lit(None).cast("string"),
    }
    values = {
        "gate_reason": F.when(~F.col("was_blank") & ~short, F.col("gate.reason")),
        "keywords": F.when(good, F.col("gate.hits")),
        "confidence": F.round(sure, 4),
        "pool": F.when(good, pool),
        "text_length": F.when(good, F.length(text)),
        **{name: F.when(good, _kept(name, value, given)) for name, value in described.items()},
        "doc_type": F.col("found_type"),
    }
    return rows.withColumns(values).drop("was_blank", "gate", "class", "found_type")


def _kept(name: str, found: Column, given: set[str]) -> Column:
    """What the rows have already, unless it is empty."""
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), found) if name in given else found


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows per value of ``by`` and outcome: accepted or the reason of rejection."""
    return rows.groupBy(*by, F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason", "gate_reason")


REASONS = ("empty", "short", "irrelevant")


def observed(rows: DataFrame, seen: Observation | str, text: str = "text", before: str = "chars_before") -> DataFrame:
    """``rows`` with counts taken as they pass: rows, accepted, each reason, retention, over_cleaned and emptied.

    ``before`` holds the characters before cleaning. With an ``Observation`` the
    counts are there after one batch action; with a name, which a stream takes,
    its listeners get them for every batch.
    """
    after = F.length(F.coalesce(F.col(text), F.lit("")))
    some = F.col(before) > 0
    kept = after / F.when(some, F.col(before))
    told = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        told(F.col("reject_reason").isNull()).alias("accepted"),
        *(told(F.coalesce(F.col("reject_reason") == r, F.lit(False))).alias(r) for r in REASONS),
        F.round(F.coalesce(F.avg(kept), F.lit(1.0)), 4).alias("retention"),
        told(some & (kept > 0) & (kept < 0.3)).alias("over_cleaned"),
        told(some & (after == 0)).alias("emptied"),
    )


def ingest_to_pools(docs: DataFrame, rules: Rules, path: str, text: str = "text", title: str | None = None) -> dict:
    """Run the chain and write the pools in one pass, and give the counts of ``observed`` taken on the way."""
    seen = Observation("ingest")
    rows = ingest(docs.withColumn("chars_before", F.length(F.coalesce(F.col(text), F.lit("")))), rules, text, title)
    write_pools(observed(rows, seen, text), path)
    return seen.get


def write_pools(rows: DataFrame, path: str) -> None:
    """Accepted rows as one folder per pool; pools that get no rows stay as they are."""
    out = accepted(rows).drop("chars_before")
    out.write.partitionBy("pool").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def news_metadata(items: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(title, keyword, publish_time, source, url) to append: titled items, each title once, without those that are known."""
    order = [F.coalesce("publish_time", F.lit("")), F.coalesce("url", F.lit(""))]
    rows = knowledge.titled(items, "title", order).select(F.trim("title").alias("title"), "keyword", "publish_time", "source", "url")
    return rows if known is None else rows.join(known.select("title").distinct(), "title", "left_anti")


def ingest_news(items: DataFrame, existing: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """News items through the chain: (new documents, all rows with their reasons).

    The text is title, blank line, content. The day of the time stamp is the
    date, whatever the text names. New are accepted documents whose key
    (source and begin of the text) ``existing`` (key) does not have, each once.
    """
    text = F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("content", F.lit(""))), F.lit("")))
    rows = items.withColumn("text", text).withColumn("publish_date", extraction.normalised_date(F.lit(None).cast("string"), F.col("publish_time")))
    judged = ingest(rows, rules)
    keyed = accepted(judged).withColumn("key", knowledge.doc_key(F.col("source"), F.col("text")))
    return knowledge.new_documents(existing, keyed, "key", [F.coalesce("publish_time", F.lit("")), F.coalesce("url", F.lit(""))]), judged
