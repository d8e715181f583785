"""Conversations as tables of turns (conv_id, turn, role, text): pairs, compression, summaries, contexts, review candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUMMARY_CHARS = 2000


def _order():
    return Window.partitionBy("conv_id").orderBy("turn")


def question_answer_pairs(turns: DataFrame, question_chars: int | None = 200, answer_chars: int | None = 500) -> DataFrame:
    """User turns with the answer that follows, if one does: (conv_id, turn, question, answer)."""
    cut = lambda c, n: F.col(c) if n is None else F.substring(c, 1, n)
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(_order()).alias("next"), F.lead("text").over(_order()).alias("answer"))
    return rows.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", cut("question", question_chars).alias("question"), cut("answer", answer_chars).alias("answer"))


def compression(turns: DataFrame, threshold: int = 10, keep: int = 8, marks: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, begin, end): the turns [begin, end) to be summarised next.

    From ``threshold`` turns on all but the last ``keep`` are summarised, each
    once: ``marks`` (conv_id, upto) say how far that has come. begin = end where
    there is nothing to do.
    """
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    rows = rows.join(marks, "conv_id", "left") if marks is not None else rows.withColumn("upto", F.lit(0))
    begin = F.coalesce(F.col("upto").cast("long"), F.lit(0).cast("long"))
    end = F.when(F.col("n_turns") >= threshold, F.greatest(begin, F.col("n_turns") - keep)).otherwise(begin)
    return rows.select("conv_id", "n_turns", begin.alias("begin"), end.alias("end"))


def recent(turns: DataFrame, keep: int = 8, initial: str | None = None) -> DataFrame:
    """The last ``keep`` turns, of these without those of kind ``initial``, which is told elsewhere."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= keep).drop("back")
    return rows.where(~F.col("kind").eqNullSafe(F.lit(initial))) if initial else rows


def summaries(pairs: DataFrame, existing: DataFrame | None = None, chars: int = SUMMARY_CHARS) -> DataFrame:
    """(conv_id, summary): what was there, then the begin of each question and the first line of its answer.

    Lines that begin beyond ``chars`` cannot be seen in the summary; they are
    left out by their place before anything is collected, so a very long
    conversation gives a bounded list.
    """
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.when(F.size(lines) > 0, F.substring(F.element_at(lines, 1), 1, 150)).otherwise("(no answer)")
    rows = pairs.select("conv_id", "turn", F.concat(F.lit("- Q: "), F.substring("question", 1, 80), F.lit(" -> "), first).alias("line"))
    if existing is not None:
        rows = rows.unionByName(existing.where("summary <> ''").select("conv_id", F.lit(-1).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.col("summary").alias("line")))
    before = F.coalesce(F.sum(F.length("line") + 1).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = rows.withColumn("before", before).where(F.col("before") < chars)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return seen.groupBy("conv_id").agg(F.substring(joined, 1, chars).alias("summary"))


def messages(turns: DataFrame, summary: DataFrame, questions: DataFrame, keep: int = 8) -> DataFrame:
    """(conv_id, place, role, text): summary, last turns, and the new question unless it is the last turn already."""
    head = summary.where("summary <> ''").select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("summary").alias("text"))
    last = recent(turns, keep).select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text")
    newest = turns.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("newest"))
    asked = questions.join(newest, "conv_id", "left").where(~F.coalesce((F.col("newest.role") == "user") & (F.col("newest.text") == F.col("question")), F.lit(False)))
    tail = asked.select("conv_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "turn")) - 1
    return head.unionByName(last).unionByName(tail).select("conv_id", place.alias("place"), "role", "text")


def candidates(turns: DataFrame, scores: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, query, answer, score, risk, class): every answer, whole, with the user turn before it.

    scores (conv_id, turn, score, risk). class is 0 with a score, 1 if the check
    was skipped, 2 without any: the order is class, then score, so the worst come
    first and what was not checked is not taken for the worst. ``seen``
    (conv_id, turn) leaves out what was exported before.
    """
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("query", asked).where("role = 'assistant'").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.select("conv_id", "turn", F.coalesce("query", F.lit("")).alias("query"), F.trim("text").alias("answer"))
    rows = rows.join(scores, ["conv_id", "turn"], "left") if scores is not None else rows.withColumns({"score": F.lit(None).cast("double"), "risk": F.lit(None).cast("string")})
    if seen is not None:
        rows = rows.join(seen, ["conv_id", "turn"], "left_anti")
    kind = F.when(F.col("score").isNull() & ~F.col("risk").eqNullSafe("unknown"), 2).when(F.col("risk").isin("skipped", "unknown"), 1).otherwise(0)
    return rows.withColumn("class", kind)


def worst_first(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("class", F.coalesce(F.when(F.col("class") == 0, F.col("score")), F.lit(0.0)), "conv_id", "turn").limit(n)


def sessions(turns: DataFrame, title_chars: int = 40) -> DataFrame:
    """(conv_id, n_turns, last_turn, title) of every conversation; its first question names it."""
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    return rows.select("conv_id", "n_turns", "last_turn", F.substring(F.coalesce("first", F.lit("")), 1, title_chars).alias("title"))


def appended(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Turns with new ones (conv_id, role, text, at) behind them, numbered on in the order of ``at``."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    more = new.withColumn("place", place).join(last, "conv_id", "left")
    return turns.unionByName(more.select("conv_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast(dict(turns.dtypes)["turn"]).alias("turn"), "role", "text"), allowMissingColumns=True)


def without_sessions(turns: DataFrame, ids: DataFrame) -> DataFrame:
    return turns.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")
