"""Score cards of processing stages, filter evaluation and store consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, predicates
from ..functions.tokens import CJK
from ..staging import if_few, staged


def group_scores(stages: DataFrame) -> DataFrame:
    """(run, group, score, worst_stage) of stage rows (run, stage, group, score)."""
    return stages.groupBy("run", "group").agg(F.avg("score").alias("score"), F.min_by("stage", F.struct("score", "stage")).alias("worst_stage"))


def overall_score(groups: DataFrame, weights: dict[str, float], renormalise: bool = False) -> DataFrame:
    """(run, overall): the weighted mean of group scores.

    The divisor is the weight of the groups present, but at least 1, so missing
    groups lower the score; with ``renormalise`` they do not.
    """
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("group") == name, w).otherwise(weight)
    total = F.sum(weight)
    return groups.groupBy("run").agg((F.sum(weight * F.col("score")) / (total if renormalise else F.greatest(total, F.lit(1.0)))).alias("overall"))


def filter_leakage(hits: DataFrame, allowed: DataFrame, traps: DataFrame) -> DataFrame:
    """Per query: hits, how many are not allowed (leaks), and how many are traps."""
    hits = staged(hits.select("query_id", "key"), "leak-hits")
    keys = if_few(hits.select("key"))
    allowed, traps = (rows.join(keys, "key", "left_semi") for rows in (allowed, traps))
    rows = hits.join(allowed.select("key", F.lit(1).alias("ok")), "key", "left").join(traps.select("key", F.lit(1).alias("trap")), "key", "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("leaks"), F.sum(F.coalesce("trap", F.lit(0))).cast("long").alias("trap_hits"))


def consistency(stores: dict[str, DataFrame], key: str) -> DataFrame:
    """(store, n_rows, n_keys, missing, extra) against the first store, by key sets and not by counts alone."""
    names = list(stores)
    base = stores[names[0]].select(key).distinct()
    out = None
    for name in names:
        keys = stores[name].select(key).distinct()
        sizes = stores[name].agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
        missing = base.join(keys, key, "left_anti").agg(F.count("*").alias("missing"))
        extra = keys.join(base, key, "left_anti").agg(F.count("*").alias("extra"))
        row = sizes.crossJoin(missing).crossJoin(extra).select(F.lit(name).alias("store"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def update_postings(postings: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Postings without the removed keys and with those of added documents, which replace equal keys."""
    gone = removed.select("key").unionByName(added.select("key")).distinct()
    return postings.join(gone, "key", "left_anti").unionByName(added)


def worst_stages(stages: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` lowest stages of each run (run, stage, group, score), with their place."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("score", "stage"))
    return stages.withColumn("place", place).where(F.col("place") <= n)


def stage_group(stage: Column, groups: dict[str, list[str]], prefixes: dict[str, str]) -> Column:
    """The group of a stage by its name, else by the begin of its name; null if neither is known."""
    out = F.lit(None).cast("string")
    for prefix, name in prefixes.items():
        out = F.when(stage.startswith(prefix), name).otherwise(out)
    for name, known in groups.items():
        out = F.when(stage.isin(known), name).otherwise(out)
    return out


def term_search_score(query_terms: Column, matched: Column, top: Column) -> Column:
    """0.4 of the share of query terms found, 0.6 of twice the best score, at most 1."""
    return 0.4 * matched / F.greatest(query_terms, F.lit(1)) + 0.6 * F.least(F.lit(1.0), F.greatest(top * 2, F.lit(0.0)))


def vector_search_score(n_hits: Column, top: Column) -> Column:
    """0.3 of the hits, five of which are enough, 0.7 of one and a half times the best similarity, at most 1."""
    return 0.3 * F.least(F.lit(1.0), n_hits / 5) + 0.7 * F.least(F.lit(1.0), F.greatest(top * 1.5, F.lit(0.0)))


def fusion_score(fused: Column, first: Column, second: Column, consensus: Column) -> Column:
    """0.5 of the share that both channels found, 0.3 of how even they are, 0.2 of the hits, five of which are enough."""
    even = 1 - F.abs(first - second) / F.greatest(first + second, F.lit(1))
    return 0.5 * consensus / F.greatest(fused, F.lit(1)) + 0.3 * even + 0.2 * F.least(F.lit(1.0), fused / 5)


def rerank_score(n_hits: Column, top: Column, high: Column) -> Column:
    """Half of 1.2 times the best score, at most 1, half of the share of high ones."""
    return 0.5 * F.least(F.lit(1.0), F.greatest(top * 1.2, F.lit(0.0))) + 0.5 * high / F.greatest(n_hits, F.lit(1))


def index_health(docs: DataFrame, text: str, words: Column, engines: int, engines_up: int) -> DataFrame:
    """One row (n_docs, n_empty, vocabulary, score): 0.35 of words per document, a hundred of which are enough, 0.35 of documents with text, 0.3 of the engines that are up."""
    sizes = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum((F.trim(F.coalesce(text, F.lit(""))) == "").cast("long")), F.lit(0).cast("long")).alias("n_empty"))
    # Words are made distinct by their own shuffle before they are counted.
    vocabulary = docs.select(F.explode(words).alias("word")).distinct().agg(F.count("*").alias("vocabulary"))
    n = F.greatest("n_docs", F.lit(1))
    score = 0.35 * F.least(F.lit(1.0), F.col("vocabulary") / n / 100) + 0.35 * (F.col("n_docs") - F.col("n_empty")) / n + 0.3 * engines_up / engines
    return sizes.crossJoin(vocabulary).select("n_docs", "n_empty", "vocabulary", F.round(score, 4).alias("score"))  # one row each


def pipeline_status(entries: DataFrame, cleaned: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Per file: entries read, left after cleaning, new ones, and a status (imported, known, rejected, empty)."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    rows = count(entries, "n_read").join(count(cleaned, "n_clean"), key, "left").join(count(new, "n_new"), key, "left").na.fill(0, ["n_clean", "n_new"])
    status = F.when(F.col("n_new") > 0, "imported").when(F.col("n_clean") > 0, "known").when(F.col("n_read") > 0, "rejected").otherwise("empty")
    return rows.withColumn("status", status)


def score_lines(stages: DataFrame) -> DataFrame:
    """(run, text): a run's stages, worst first, a line each."""
    line = F.format_string("- %s: %.2f", F.col("stage"), F.col("score"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("score", "stage", line.alias("line")))), lambda x: x["line"])
    return stages.groupBy("run").agg(F.array_join(lines, "\n").alias("text"))


# Signs that end a sentence.
SENTENCE_ENDS = ("。", "！", "？", "；", ".", "!", "?", "\n")


def text_scores(docs: DataFrame, by: list[str] | None = None, script: str = CJK, text: str = "text") -> DataFrame:
    """How good texts are to index, one row for each value of ``by``; without any one row, also for no documents.

    (doc_count, avg_length, script_ratio, avg_paragraphs, empty_docs, score, grade,
    warnings). Content is the mean share of the script, 0.3 of which is enough,
    and the mean number of paragraphs over 20 characters, five of which are; size
    is best from 50 to 5,000 characters; texts under ten characters are empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.length(body)
    bare = lambda x: F.length(cleaning.strip(x))
    told = docs.select(*(by or []), n.alias("n"), F.when(n > 0, (n - F.length(F.regexp_replace(body, script + "+", ""))) / n).otherwise(0.0).alias("share"), F.size(F.filter(F.split(body, "\n\n"), lambda p: bare(p) > 20)).alias("paras"), (bare(body) < 10).cast("long").alias("empty"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = told.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("doc_count"), zero(F.avg("n")).alias("avg_length"), zero(F.avg("share")).alias("script_ratio"), zero(F.avg("paras")).alias("avg_paragraphs"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_docs"))
    length, share, paras = F.col("avg_length"), F.col("script_ratio"), F.col("avg_paragraphs")
    empty = F.col("empty_docs") / F.greatest("doc_count", F.lit(1))
    content = F.least(F.lit(1.0), share / 0.3 * 0.5 + F.least(paras / 5, F.lit(1.0)) * 0.5)
    size = F.when(length < 50, length / 50).when(length <= 5000, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (length - 5000) / 20000))
    score = F.when(F.col("doc_count") > 0, content * 0.4 + size * 0.3 + (1 - empty) * 0.3).otherwise(0.0)
    return _scored(rows, score, {"no documents": F.col("doc_count") == 0, "little of the script": share < 0.1, "short texts": empty > 0.1, "few paragraphs": paras < 1})


def chunk_scores(chunks: DataFrame, by: list[str] | None = None, chunk_size: int = 500, text: str = "text", ends: tuple[str, ...] = SENTENCE_ENDS) -> DataFrame:
    """How well texts were cut, one row for each value of ``by``; without any one row, also for no chunks.

    (chunk_count, avg_size, min_size, max_size, std_dev, uniformity, boundary_quality,
    small_chunk_ratio, oversized_ratio, score, grade, warnings). Uniformity falls
    with the variation of sizes; a good boundary is the end of a sentence; small is
    under 50 characters, oversized one and a half times the size asked for.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n")
    told = chunks.select(*(by or []), F.length(body).alias("n"), F.substring(body, -1, 1).isin(*ends).cast("long").alias("ended"))
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rows = told.groupBy(*(by or [])).agg(
        *(F.count(F.lit(1)).alias("chunk_count"), share(n).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.coalesce(F.stddev_pop("n"), F.lit(0.0)).alias("std_dev")),
        *(share("ended").alias("boundary_quality"), share((n < 50).cast("long")).alias("small_chunk_ratio"), share((n > chunk_size * 1.5).cast("long")).alias("oversized_ratio")),
    )
    rows = rows.withColumn("uniformity", F.greatest(F.lit(0.0), 1.0 - F.col("std_dev") / F.greatest("avg_size", F.lit(1.0)) * 0.8))
    small = F.greatest(F.lit(0.0), 1.0 - F.col("small_chunk_ratio") * 3)
    score = F.when(F.col("chunk_count") > 0, F.col("uniformity") * 0.35 + F.col("boundary_quality") * 0.35 + small * 0.3).otherwise(0.0)
    some = F.col("chunk_count") > 0
    return _scored(rows, score, {"no chunks": ~some, "many small chunks": F.col("small_chunk_ratio") > 0.2, "oversized chunks": F.col("oversized_ratio") > 0.1, "cut within sentences": some & (F.col("boundary_quality") < 0.5)})


def _scored(rows: DataFrame, score: Column, warnings: dict[str, Column]) -> DataFrame:
    said = F.array(*(F.when(when, F.lit(text)) for text, when in warnings.items()))
    rows = rows.withColumn("score", score)
    return rows.withColumns({"grade": predicates.grade(F.col("score")), "warnings": F.filter(said, lambda x: x.isNotNull())})
