"""Chunking of documents and assembly of context under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import share_package

# Separators from coarse to fine, and chunk sizes by document type.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";")
SIZES = {"news": 500, "financial_report": 1500, "research": 1000}
# Size, overlap and least size of the named strategies.
STRATEGIES = {"default": (500, 50, 50), "paragraph": (1500, 100, 100), "none": (999_999, 0, 1)}
SENTENCE_END = r"(?s)^.*[。！？；!?;.\n]"


def split_text(text: str, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """Cut a text into (offset, chunk) of at most ``size`` characters.

    A piece that is too long is cut at the coarsest separator it has, which
    stays with what stands before it; neighbours are packed while they fit.
    Without any separator it is cut by length.
    """

    def cut(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if end - start <= size:
            return [(start, end)]
        for i in range(level, len(separators)):
            sep = separators[i]
            marks, at = [start], text.find(sep, start, end)
            while at >= 0:
                marks.append(at + len(sep))
                at = text.find(sep, at + len(sep), end)
            if marks[-1] != end:
                marks.append(end)
            if len(marks) > 2:
                out: list[tuple[int, int]] = []
                for a, b in zip(marks, marks[1:], strict=False):
                    if b - a > size:
                        out += cut(a, b, i + 1)
                    elif out and b - out[-1][0] <= size:
                        out[-1] = out[-1][0], b
                    else:
                        out.append((a, b))
                return out
        return [(a, min(a + size, end)) for a in range(start, end, size)]

    return [(a, text[a:b]) for a, b in cut(0, len(text), 0) if b > a]


def merge_small(chunks: list[tuple[int, str]], least: int) -> list[tuple[int, str]]:
    """Chunks shorter than ``least`` join the one before."""
    out: list[tuple[int, str]] = []
    for at, text in chunks:
        if out and len(text) < least:
            out[-1] = out[-1][0], out[-1][1] + text
        else:
            out.append((at, text))
    return out


def chunk_documents(docs: DataFrame, size: int | Column = 500, overlap: int = 50, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk_count, chunk_start, text): chunks in order.

    ``chunk_start`` is the true offset of a chunk without the overlap that is
    put before it: the last ``overlap`` characters of the chunk before. Blank
    and null texts give no chunks.
    """
    share_package(docs.sparkSession)

    @F.pandas_udf("array<struct<chunk_start:int,text:string>>")
    def pieces(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for text, n in zip(texts, sizes, strict=True):
            parts = merge_small(split_text(text, int(n)), least) if text and text.strip() else []
            out.append([{"chunk_start": at, "text": (parts[i - 1][1][-overlap:] if i and overlap else "") + body} for i, (at, body) in enumerate(parts)])
        return pd.Series(out)

    n = size if isinstance(size, Column) else F.lit(size)
    rows = docs.select(F.col(id_col).alias("doc_id"), pieces(F.col(text_col), n.cast("int")).alias("chunks"))
    each = rows.select("doc_id", F.size("chunks").alias("chunk_count"), F.posexplode("chunks").alias("chunk_id", "c"))
    return each.select("doc_id", "chunk_id", "chunk_count", F.col("c.chunk_start").alias("chunk_start"), F.col("c.text").alias("text"))


def size_by_type(doc_type: Column, other: int = 500) -> Column:
    out = F.lit(other)
    for name, n in SIZES.items():
        out = F.when(doc_type == name, n).otherwise(out)
    return out


def source_id(url: Column, title: Column, place: Column) -> Column:
    """The id of a document's chunks: its URL, else its title, else ``doc_`` and its place."""
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(title, F.lit("")), F.concat(F.lit("doc_"), place.cast("string")))


def chunked(docs: DataFrame, strategy: str = "default", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks by a named strategy; an unknown name is the default one."""
    size, overlap, least = STRATEGIES.get(strategy, STRATEGIES["default"])
    return chunk_documents(docs, size, overlap, least, id_col, text_col)


def chunked_by_type(docs: DataFrame, overlap: int = 50, least: int = 50, place: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source_id, doc_type, chunk_id, chunk_count, chunk_start, text) of documents (doc_id, url, title, doc_type, text).

    The type decides the size of a chunk, and url, title or place name its source.
    Documents of one source have their chunks numbered each from 0.
    """
    kind = F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("other"))
    rows = docs.select(F.struct(source_id(F.col("url"), F.col("title"), F.col(place)).alias("source_id"), kind.alias("doc_type")).alias("id"), F.col(text_col).alias("text"))
    chunks = chunk_documents(rows, size_by_type(F.col("id.doc_type")), overlap, least, "id", "text")
    return chunks.select("doc_id.source_id", "doc_id.doc_type", "chunk_id", "chunk_count", "chunk_start", "text")


def sentence_cut(text: Column, budget: Column) -> Column:
    """The start of ``text`` within ``budget`` characters, up to its last sentence end if it has one."""
    head = F.substring(text, F.lit(1), budget)
    cut = F.regexp_extract(head, SENTENCE_END, 0)
    return F.when(F.length(text) <= budget, text).when(cut != "", cut).otherwise(head)


def build_context(items: DataFrame, budget: int = 2000, max_items: int = 10, min_score: float = 0.0, least: int = 20) -> DataFrame:
    """Per query: which items (query_id, key, rank, score, text) fill a character budget.

    Items under ``min_score`` go first, then all but the ``max_items`` of best
    rank. The rest take what they need of the budget in order; one that does not
    fit is cut at a sentence end and takes what is left of it, and is dropped if
    fewer than ``least`` characters are left. Returns one row per item with
    n_chars, used_chars and status (kept, cut, dropped).
    """
    enough = items.where(F.col("score") >= min_score).where(F.col("rank") <= max_items)
    rows = enough.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score", "text"))).alias("items"))
    # The state of the fold is what is left of the budget and the rows so far.
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<rank:int,key:bigint,n_chars:int,used_chars:int>>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        short = F.length(sentence_cut(x["text"], state["left"]))
        used = F.when(F.length(x["text"]) <= state["left"], F.length(x["text"])).when(state["left"] < least, 0).otherwise(short)
        row = F.struct(x["rank"].cast("int").alias("rank"), x["key"].cast("long").alias("key"), F.length(x["text"]).alias("n_chars"), used.alias("used_chars"))
        return F.struct((state["left"] - used).alias("left"), F.concat(state["done"], F.array(row)).alias("done"))

    each = rows.select("query_id", F.explode(F.aggregate("items", start, step)["done"]).alias("x")).select("query_id", "x.*")
    status = F.when(F.col("used_chars") == 0, "dropped").when(F.col("used_chars") < F.col("n_chars"), "cut").otherwise("kept")
    return each.select("query_id", "key", "rank", "n_chars", "used_chars", status.alias("status"))


def context_report(built: DataFrame, budget: int = 2000) -> DataFrame:
    """Per query of ``build_context``: items by status, used characters, their share of the budget and of the texts, and a warning.

    The warning is ``nothing_fits`` if all items were dropped, ``mostly_cut`` if
    under half of the characters are used, else null.
    """
    of = lambda status: F.sum((F.col("status") == status).cast("long"))
    rows = built.groupBy("query_id").agg(F.count("*").alias("n_items"), of("kept").alias("n_kept"), of("cut").alias("n_cut"), of("dropped").alias("n_dropped"), F.sum("used_chars").alias("used_chars"), F.sum("n_chars").alias("n_chars"))
    fidelity = F.round(F.when(F.col("n_chars") > 0, F.col("used_chars") / F.col("n_chars")).otherwise(1.0), 4)
    rows = rows.withColumn("utilisation", F.round(F.col("used_chars") / budget, 4)).withColumn("fidelity", fidelity)
    warning = F.when(F.col("n_dropped") == F.col("n_items"), "nothing_fits").when(F.col("fidelity") < 0.5, "mostly_cut")
    return rows.withColumn("warning", warning).drop("n_chars")


def chunk_report(chunks: DataFrame, words: list[str], short: int = 50) -> DataFrame:
    """Per document of chunk rows (doc_id, chunk_id, text): chunks, their least, mean and greatest size, short ones, and dictionary words that occur in some."""
    n = F.length("text")
    found = F.array(*(F.when(F.contains(F.col("text"), F.lit(w)), F.lit(w)) for w in words))
    rows = chunks.withColumn("found", F.filter(found, lambda x: x.isNotNull()))
    sizes = [F.count("*").alias("n_chunks"), F.min(n).alias("least"), F.round(F.avg(n), 2).alias("mean"), F.max(n).alias("most"), F.sum((n < short).cast("long")).alias("n_short")]
    return rows.groupBy("doc_id").agg(*sizes, F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("words"))
