"""Retrieval in rounds: what a round finds asks the next one, until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import if_few, staged

#: (query_id, query) to hits (query_id, text, source, score); queries may be few or many.
Search = Callable[[DataFrame], DataFrame]
#: The next query of an open one: a column of query, and text and source of its best new hit; null or blank ends it.
Next = Callable[[Column, Column, Column], Column]


def _plain(query: Column) -> Column:
    return F.trim(F.coalesce(query, F.lit("")))


def searched_in_rounds(queries: DataFrame, search: Search, next_query: Next, max_rounds: int = 5, min_score: float = 0.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, trace, outcome) of queries (query_id, query) that ask again with what they found.

    evidence (query_id, text, round, source, score): each text of a query once, in
    its first round, if it scores ``min_score`` there; blank texts are none. trace
    (query_id, round, query, n_found, n_new, best): what each round asked and
    brought. outcome (query_id, rounds, stopped): stopped is ``nothing new`` if the
    last round brought no text that was not there, ``no query`` if there was none
    to ask, blank or asked before, ``rounds`` if ``max_rounds`` ended it.

    A round searches only for queries that the last one left open. Rounds are
    written tables, so each is computed once and a lost executor costs a re-read;
    the driver sees only how many queries are open. Of rows with one query_id the
    first by query counts; rows without an id are left out.
    """
    if max_rounds < 1:
        raise ValueError("there must be a round")
    asked = queries.where("query_id is not null").groupBy("query_id").agg(F.min(_plain(F.col("query"))).alias("query"))
    every = staged(asked, "round-queries")
    open_, found, trace = every.where("query <> ''"), None, None
    for number in range(1, max_rounds + 1):
        hits = search(open_.select("query_id", "query")).where("query_id is not null").select("query_id", F.trim("text").alias("text"), "source", F.col("score").cast("double").alias("score"))
        hits = staged(hits, "round-hits")
        # Of equal texts of a round the best counts, of equal scores the first source.
        order = F.struct((-F.col("score")).alias("s"), F.coalesce("source", F.lit("")).alias("source"))
        good = hits.where((F.col("score") >= min_score) & (F.coalesce("text", F.lit("")) != "")).groupBy("query_id", "text").agg(F.min(order).alias("o"))
        if found is not None:
            good = good.join(found.select("query_id", "text"), ["query_id", "text"], "left_anti")
        new = staged(good.select("query_id", "text", F.lit(number).alias("round"), F.col("o.source").alias("source"), (-F.col("o.s")).alias("score")), "round-new")
        found = new if found is None else found.unionByName(new)

        told = hits.groupBy("query_id").agg(F.count("*").alias("n_found"), F.max("score").alias("best"))
        best = new.groupBy("query_id").agg(F.count("*").alias("n_new"), F.min(F.struct((-F.col("score")).alias("s"), "text", "source")).alias("first"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        rows = open_.select("query_id", "query").join(told, "query_id", "left").join(best, "query_id", "left")
        follows = _plain(next_query(F.col("query"), F.col("first.text"), F.col("first.source")))
        rows = rows.select("query_id", F.lit(number).alias("round"), "query", zero("n_found"), zero("n_new"), "best", F.when(F.col("n_new") > 0, follows).alias("follows"))
        rows = staged(rows, "round-trace")
        trace = rows if trace is None else trace.unionByName(rows)

        ahead = rows.where("follows <> ''").select("query_id", F.col("follows").alias("query"))
        # A query that was asked before would only find the same again.
        open_ = staged(ahead.join(trace.select("query_id", "query"), ["query_id", "query"], "left_anti"), "round-queries")
        if number == max_rounds or open_.limit(1).count() == 0:
            break
    last = trace.groupBy("query_id").agg(F.max_by(F.struct("round", "n_new"), "round").alias("last"))
    left = open_.select("query_id", F.lit(True).alias("left"))
    stopped = F.when(F.col("left"), "rounds").when(F.col("last.n_new") == 0, "nothing new").otherwise("no query")
    outcome = every.select("query_id").join(last, "query_id", "left").join(if_few(left), "query_id", "left")
    outcome = outcome.select("query_id", F.coalesce("last.round", F.lit(0)).alias("rounds"), stopped.alias("stopped"))
    return found, trace.drop("follows"), outcome
