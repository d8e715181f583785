"""The batch cleaning and gating, applied to a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import predicates
from ..operators import ingest as chain


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def zoned(rows: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant; a local time is taken in the session's zone."""
    return rows.withColumn(time, F.col(time).cast("timestamp")) if dict(rows.dtypes)[time] == "timestamp_ntz" else rows


def accepted(rows: DataFrame, words: list[str], script: str, text: str = "text", min_chars: int = 20, min_share: float = 0.1) -> DataFrame:
    """Rows that pass the relevance gate, batch or stream."""
    return rows.where(predicates.relevance_gate(F.col(text), words, script, min_chars, min_share)["passed"])


def deduplicated(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state beyond it is dropped."""
    return zoned(rows, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, by: str, width: str = "10 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(start, by, n): tumbling window counts; with append output a window comes once it is closed.

    ``late`` is None for rows that have a watermark, which is set once in a stream.
    """
    marked = zoned(rows, time).withWatermark(time, late) if late else rows
    counted = marked.groupBy(F.window(time, width).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def ingested(rows: DataFrame, rules: chain.Rules, key: str | None = None, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The ingest chain on a stream: accepted rows, described and routed; with a key and a time each key once within the watermark."""
    good = chain.accepted(chain.ingest(rows, rules))
    return deduplicated(good, key, time, late) if key and time else good


def rejections(rows: DataFrame, rules: chain.Rules) -> DataFrame:
    """Running counts of outcomes, for a stream in complete or update mode."""
    return chain.outcome_counts(chain.ingest(rows, rules), [])
