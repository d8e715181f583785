"""Evidence of several origins: first of equal texts, numbered for citation, and written out for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(parts: list[DataFrame], max_items: int | None = None) -> DataFrame:
    """(query_id, place, text, source, score): the parts in their order, texts once, numbered from 1.

    Each part has query_id, text, source, score; within a part the better score
    comes first. Blank texts are none, and texts are compared without white
    space at their ends.
    """
    out = None
    for i, part in enumerate(parts):
        rows = part.select("query_id", F.trim("text").alias("text"), "source", F.col("score").cast("double").alias("score"), F.lit(i).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    rank = F.struct("part", (-F.coalesce("score", F.lit(0.0))).alias("s"), F.coalesce("source", F.lit("")).alias("source"))
    one = out.where("text <> ''").groupBy("query_id", "text").agg(F.min(rank).alias("r"), F.min_by("score", rank).alias("score"), F.min_by("source", rank).alias("source"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("r.part", "r.s", "text"))
    rows = one.withColumn("place", place)
    return (rows if max_items is None else rows.where(F.col("place") <= max_items)).select("query_id", "place", "text", "source", "score")


def rounds_deduplicated(found: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Of evidence found in several rounds (query_id, round, text, source, score) each text once, in its first round, if it scores enough."""
    good = found.where((F.col("score") >= min_score) & (F.coalesce("text", F.lit("")) != ""))
    first = F.struct("round", (-F.col("score")).alias("s"), F.coalesce("source", F.lit("")).alias("source"))
    one = good.groupBy("query_id", "text").agg(F.min(first).alias("f"))
    return one.select("query_id", "text", F.col("f.round").alias("round"), F.col("f.source").alias("source"), F.round(-F.col("f.s"), 4).alias("score"))


def round_trace(found: DataFrame) -> DataFrame:
    """(query_id, round, n_found, best): what each round brought, before any text is left out."""
    return found.groupBy("query_id", "round").agg(F.count("*").alias("n_found"), F.max("score").alias("best"))


def sources_text(items: DataFrame, item_chars: int = 800, total_chars: int = 12_000, more: str = "\n... (more sources were cut)") -> DataFrame:
    """(query_id, text): numbered sources for a prompt, each cut, and the whole cut with a note.

    Items (query_id, place, title, date, source, text). What would begin beyond
    the limit is left out before it is collected.
    """
    note = lambda left, c, right: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(left), c, F.lit(right))).otherwise("")
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), note(" (", F.col("date"), ")"), note(" - source: ", F.col("source"), ""))
    rows = items.select("query_id", "place", F.concat(head, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, item_chars)).alias("block"))
    window = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("block") + 2).over(window), F.lit(0))).where(F.col("before") <= total_chars)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n")
    out = rows.groupBy("query_id").agg(joined.alias("text"))
    return out.select("query_id", F.when(F.length("text") > total_chars, F.concat(F.substring("text", 1, total_chars), F.lit(more))).otherwise(F.col("text")).alias("text"))


def news_lines(title: Column, keyword: Column, time: Column) -> Column:
    """One line for a news item, of what it has; null if it has nothing."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    line = F.concat_ws(" | ", some("", title), some("keyword: ", keyword), some("time: ", time))
    return F.when(line != "", F.concat(F.lit("- "), line))


def news_context(items: DataFrame, max_items: int = 10) -> DataFrame:
    """(query_id, text): the first items (query_id, place, title, keyword, publish_time), a line each."""
    rows = items.where(F.col("place") <= max_items).select("query_id", F.struct("place", news_lines(F.col("title"), F.col("keyword"), F.col("publish_time")).alias("line")).alias("x"))
    lines = F.filter(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), lambda x: x.isNotNull())
    return rows.groupBy("query_id").agg(F.array_join(lines, "\n").alias("text"))


def truncated(text: Column, chars: int = 3000, mark: str = "\n[cut]") -> Column:
    """Text for a prompt, with a mark where it was cut, so that nothing is cut in silence."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(mark))).otherwise(text)


def provenance(hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, documents): how many hits an answer rests on, and their distinct documents in order of rank."""
    first = hits.groupBy("query_id", "source").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"])
    return first.groupBy("query_id").agg(F.sum("n").alias("n_hits"), ordered.alias("documents"))


def full_text(sections: dict[str, Column]) -> Column:
    """The filled sections of a structured answer as one text, in the order given; lists as bullets. What a check reads."""

    def written(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"【{name}】\n"), value))

    return F.concat_ws("\n\n", *(written(name, value) for name, value in sections.items()))


def bullets(values: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
