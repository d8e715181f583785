"""Readers of document files and sinks of snapshots and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package

EXTENSIONS = ("jsonl", "json", "txt", "pdf")
_LINE = "title string, content string, text string, source string, metadata map<string,string>, meta map<string,string>, _corrupt_record string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, text, meta, error): one row per line.

    The text is title, blank line, content if both or either are there, else the
    field text. Lines that are no JSON or have no text stay, with an error.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value").where(F.trim("value") != "")
    body = F.coalesce(F.nullif(F.concat_ws("\n\n", F.nullif("r.title", F.lit("")), F.nullif("r.content", F.lit(""))), F.lit("")), F.col("r.text"))
    error = F.when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), "bad line").when(F.coalesce(body, F.lit("")) == "", "no text")
    return rows.select("file", F.coalesce("r.source", "file").alias("source"), body.alias("text"), F.coalesce("r.metadata", "r.meta").alias("meta"), error.alias("error"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, text, meta, error): one document per txt file, stripped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    file = F.col("_metadata.file_name")
    return raw.select(file.alias("file"), file.alias("source"), text.alias("text"), F.lit(None).cast("map<string,string>").alias("meta"), F.when(text == "", "no text").alias("error"))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, text, meta, error): json files of one object or a list; content, else text."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    item = "struct<content:string,text:string,source:string>"
    listed = F.from_json("value", f"array<{item}>")
    single = F.from_json("value", item)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.explode_outer(F.when(F.trim("value").startswith("["), listed).otherwise(F.array(single))).alias("r"))
    text = F.coalesce("r.content", "r.text")
    return rows.select("file", F.coalesce("r.source", "file").alias("source"), text.alias("text"), F.lit(None).cast("map<string,string>").alias("meta"), F.when(F.coalesce(text, F.lit("")) == "", "no text").alias("error"))


def read_binary(spark: SparkSession, path: str, parse: Callable[[bytes], str], glob: str = "*.pdf") -> DataFrame:
    """(file, source, text, meta, error): files that ``parse`` turns into text; a failure is a row with its error."""
    share_package(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors = [], []
            for data in part["content"]:
                try:
                    texts.append(parse(bytes(data)))
                    errors.append(None)
                except Exception as problem:  # any failure of a parser belongs to its file
                    texts.append(None)
                    errors.append(str(problem)[:200])
            yield pd.DataFrame({"path": part["path"], "text": texts, "error": errors})

    rows = raw.select("path", "content").mapInPandas(run, "path string, text string, error string")
    file = F.element_at(F.split("path", "/"), -1)
    return rows.select(file.alias("file"), file.alias("source"), "text", F.lit(None).cast("map<string,string>").alias("meta"), "error")


def ingest_directory(spark: SparkSession, path: str, parse: Callable[[bytes], str] | None = None) -> DataFrame:
    """All known files below ``path`` as one table; a bad file or line never stops the others."""
    rows = read_jsonl(spark, path).unionByName(read_text_files(spark, path)).unionByName(read_json_files(spark, path))
    return rows.unionByName(read_binary(spark, path, parse)) if parse else rows


def list_directory(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """(path, file, bytes, n_documents, imported): the files below ``path`` beside what was read of them.

    ``documents`` have the column path, or only file; names that several folders
    have are told apart by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    by = "path" if "path" in documents.columns else "file"
    rows = files.join(documents.groupBy(by).agg(F.count("*").alias("n")), by, "left")
    return rows.select("path", "file", "bytes", F.coalesce("n", F.lit(0).cast("long")).alias("n_documents"), F.col("n").isNotNull().alias("imported"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """(outcome, n) of read rows: read, or the reason why there is no text."""
    return rows.groupBy(F.coalesce("error", F.lit("read")).alias("outcome")).agg(F.count("*").alias("n"))


def joined_pages(pages: DataFrame, key: str = "file", page: str = "page", text: str = "text") -> DataFrame:
    """(key, text, n_pages) of files that come page by page; blank pages are left out."""
    rows = pages.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, text))).alias("pages"))
    return rows.select(key, F.array_join(F.transform("pages", lambda x: x[text]), "\n\n").alias("text"), F.size("pages").alias("n_pages"))


def preview(spark: SparkSession, root: str, file: str, lines: int = 20, most: int = 50) -> DataFrame:
    """(line_no, line): the first lines of a text file below ``root``, from 1 to ``most`` of them.

    A name that leads out of ``root`` is an error.
    """
    parts = file.replace("\\", "/").split("/")
    if file.startswith("/") or ".." in parts or "://" in file:
        raise ValueError("the file must lie below the root")
    n = min(max(1, lines), most)
    # The first lines are those of the first partition's begin.
    head = spark.read.text(f"{root}/{file}").limit(n)
    return head.withColumn("line_no", F.monotonically_increasing_id() + 1).select("line_no", F.col("value").alias("line"))


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """(store, n_rows) of several tables."""
    out = None
    for name, rows in stores.items():
        row = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("store"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(store, n_files, bytes, modified) of folders; a folder without files has zero and no time."""
    found = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        row = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("modified")).select(F.lit(name).alias("store"), "*")
        found = row if found is None else found.unionByName(row)
    if found is None:
        raise ValueError("no paths")
    return found


def write_report(rows: DataFrame, path: str, title: str, order: list[str], template: str = "%s") -> None:
    """A Markdown report: a heading and one bullet per row, in order, as text files."""
    lines = rows.orderBy(*order).select(F.format_string("- " + template, *(F.col(c) for c in rows.columns)).alias("value"))
    head = rows.sparkSession.createDataFrame([(f"# {title}",), ("",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    lines.write.mode("append").text(path)
