"""A vector store as a table (key, text_hash, vector, version): upsert, removal, rebuild, and a cache of embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def latest(rows: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """One row per key, the one of the greatest version; equal versions are told apart by their content."""
    rest = [c for c in rows.columns if c != key]
    order = F.struct(version, F.xxhash64(*rest))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, *(F.col("row")[c].alias(c) for c in rest))


def upserted(store: DataFrame, rows: DataFrame, version: int, key: str = "key") -> DataFrame:
    """The store with the rows in place of equal keys; of rows with one key the last by content hash stays."""
    return latest(store.unionByName(rows.withColumn("version", F.lit(version).cast(dict(store.dtypes)["version"]))), key)


def removed(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def missing_and_extra(store: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """(key, state): documents without a vector (missing) and vectors without a document (extra); none if both agree."""
    a, b = docs.select(key).distinct(), store.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("extra")))


def embedded(docs: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame] | None, width: int, key: str = "key", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, vector, state) of every document, and the rows (text_hash, vector) to add to the cache.

    Texts are looked up by hash; of those that the cache lacks each is embedded
    once, by ``embed`` from (text_hash, text) to (text_hash, vector). Without it
    they get a vector of ``width`` zeros and the state ``zero``, which is never cached.
    """
    rows = docs.select(key, text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("body"))
    known = rows.join(cache.select("text_hash", F.col("vector").alias("cached")), "text_hash", "left")
    misses = known.where("cached is null").groupBy("text_hash").agg(F.first("body").alias("text"))
    zeros = F.array_repeat(F.lit(0.0), width)
    if embed is None:
        state = F.when(F.col("cached").isNull(), "zero").otherwise("hit")
        return known.select(key, F.coalesce("cached", zeros).alias("vector"), state.alias("state")), cache.limit(0).select("text_hash", "vector")
    fresh = embed(misses).select("text_hash", "vector")
    out = known.join(fresh.select("text_hash", F.col("vector").alias("made")), "text_hash", "left")
    state = F.when(F.col("cached").isNotNull(), "hit").when(F.col("made").isNotNull(), "miss").otherwise("zero")
    return out.select(key, F.coalesce("cached", "made", zeros).alias("vector"), state.alias("state")), fresh


def cache_report(found: DataFrame) -> DataFrame:
    """(state, n): hits, misses and zeros."""
    return found.groupBy("state").agg(F.count("*").alias("n"))
