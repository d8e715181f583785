"""News items as a table: events of a day, items that a query names, search keywords, plain reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import matcher
from ..staging import if_few, staged
from .knowledge import titled


def date_events(items: DataFrame, day: str, keyword: str | None = None, most: int | None = 20, order: list[Column] | None = None, content_chars: int = 300) -> DataFrame:
    """(title, content, source, publish_time, url) of the items of a day, titles once, the first ``most`` in order.

    Items (title, content, source, publish_time, url). With a keyword only those
    that have it in title or content.
    """
    rows = items.where(F.contains(F.coalesce("publish_time", F.lit("")), F.lit(day)))
    if keyword:
        rows = rows.where(F.contains(F.concat_ws("\n", "title", "content"), F.lit(keyword)))
    order = order or [F.col("publish_time"), F.col("url")]
    out = titled(rows, "title", order, "keep").orderBy(*order, "title")
    out = out.select("title", F.substring(F.coalesce("content", F.lit("")), 1, content_chars).alias("content"), F.coalesce("source", F.lit("unknown")).alias("source"), "publish_time", "url")
    return out if most is None else out.limit(most)


def named_items(queries: DataFrame, items: DataFrame, most: int = 10, least_chars: int = 2) -> DataFrame:
    """(query_id, item_id, place): the items one of whose keywords stands in the query, the first by id.

    queries (query_id, query), items (item_id, keyword); a keyword field names
    several, with 、 between. All distinct keywords are looked for in a query at
    once, and items are then joined by equality: no pairs are tested. Of a keyword
    only its first ``most`` items are joined, as no other can be among a query's.
    """
    words = items.select("item_id", F.explode(F.split(F.lower("keyword"), "、")).alias("word")).where(F.length("word") >= least_chars).distinct()
    of_word = F.row_number().over(Window.partitionBy("word").orderBy("item_id"))
    words = staged(words.withColumn("r", of_word).where(F.col("r") <= most).drop("r"), "first-items")
    find = matcher(words.select("word", F.lit(None).cast("string").alias("value"), F.lit(0).alias("place")))
    hits = queries.select("query_id", F.explode(find(F.lower("query"))).alias("hit")).select("query_id", F.col("hit")["word"].alias("word"))
    found = hits.join(if_few(words), "word").select("query_id", "item_id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def keyword_counts(items: DataFrame) -> DataFrame:
    """Items per keyword field."""
    return items.groupBy("keyword").agg(F.count("*").alias("n"))


def search_words(query: Column, proposed: Column, generic: list[str], translations: Mapping[str, str], least_chars: int = 2) -> Column:
    """The query first, then proposed words that are neither generic nor too short, then their translations; each once.

    A translation is added behind everything whose text contains its word.
    """
    some = F.filter(F.transform(F.coalesce(proposed, F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: (F.length(w) >= least_chars) & ~w.isin(generic))
    words = F.array_distinct(F.concat(F.array(query), some))
    pairs = F.array(*(F.struct(F.lit(a.lower()).alias("a"), F.lit(b).alias("b")) for a, b in translations.items()))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.transform(F.filter(pairs, lambda p: F.contains(F.lower(w), p["a"])), lambda p: p["b"])))))


def plain_report(query: Column, titles: Column, companies: Column) -> Column:
    """struct(title, findings, companies, summary) without any model: the first five titles and companies."""
    n = F.size(titles)
    findings = F.transform(F.slice(titles, 1, 5), lambda t: F.substring(t, 1, 100))
    return F.struct(F.coalesce(F.nullif(query, F.lit("")), F.lit("report")).alias("title"), findings.alias("findings"), F.slice(companies, 1, 5).alias("companies"), F.format_string("A plain analysis of %d sources.", n).alias("summary"))


def narrative(name: Column, period: Column, values: Column, units: Mapping[str, str]) -> Column:
    """One sentence on an entity's metrics: ``values`` is array<struct<metric, value>>, two decimals where a unit is known."""
    unit = F.create_map(*(F.lit(x) for pair in units.items() for x in pair)) if units else F.create_map().cast("map<string,string>")
    known = lambda x: F.try_element_at(unit, x["metric"])
    parts = F.transform(values, lambda x: F.when(known(x).isNotNull(), F.concat(x["metric"], F.lit(" "), F.format_string("%.2f", x["value"]), known(x))).otherwise(F.concat(x["metric"], F.lit(" "), x["value"].cast("string"))))
    head = F.concat_ws(" ", F.nullif(name, F.lit("")), F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit("("), period, F.lit(")"))))
    return F.concat(head, F.lit(": "), F.array_join(parts, ", "), F.lit("."))
