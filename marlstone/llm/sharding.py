"""Sharding by extendible hashing, as DataFrame operations.

A bucket is the set of rows whose hash begins with its bits. Starting from one
bucket of no bits, only buckets over the byte limit are split on another bit.
Several bits are tried in one pass: the rows of oversized buckets are summed by
a longer prefix (a partial aggregate, so hot sources cost nothing extra), the
sums are rolled up to each shorter prefix, and every bucket takes the shortest
prefix that fits. What still does not fit goes to the next pass, alone.

The directory is a table with one row per bucket: its bits and their number
(the local depth). It is never expanded to two to the power of the global depth.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import lookup, staged

#: Bits that a pass may split; the first one may split more, by the table's size.
STEP = 12
#: Bits of the hash.
BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of ``key`` as text, as a non-negative number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def build_directory(sizes: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """The buckets (depth, prefix, shard_bytes, shard_rows) of rows (h, n_bytes).

    Every bucket holds at most ``limit`` bytes, but for rows of one single hash,
    which no bit can tell apart. An empty table has one empty bucket of depth 0.
    """
    found: list[DataFrame] = []
    top = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0).cast("long")).alias("shard_bytes"), F.count("*").alias("shard_rows"))
    top = staged(top.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "shard_bytes", "shard_rows"), "buckets")
    found.append(top.where(F.col("shard_bytes") <= limit))
    open_ = top.where(F.col("shard_bytes") > limit).select("prefix")
    rows, done = sizes, 0
    # So many bits as even buckets would need, and two more: then few rows are left for another pass at any size.
    first = math.ceil(math.log2(max(1, top.first()["shard_bytes"] / max(1, limit)))) + 2
    while done < BITS and open_.limit(1).count():
        deep = min(BITS, done + (step if done else max(step, first)))
        if done:
            rows = rows.join(lookup(open_), _prefix(F.col("h"), done) == open_["prefix"], "left_semi")
        cells = rows.groupBy(_prefix(F.col("h"), deep).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
        cells = staged(cells, "cells")
        # Every cell adds to one bucket of each depth between.
        depths = F.explode(F.sequence(F.lit(done + 1), F.lit(deep))).alias("depth")
        rolled = cells.select("b", "r", "cell", depths).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        rolled = rolled.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        rolled = staged(rolled, "buckets")
        # The size falls with the depth, so the shortest prefix that fits is a child of one that does not.
        over = rolled.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        over = over.unionByName(open_.select(F.lit(done + 1).alias("depth"), F.col("prefix").alias("up")))
        fits = rolled.where(F.col("shard_bytes") <= limit).withColumn("up", F.shiftright("prefix", 1))
        found.append(fits.join(over, ["depth", "up"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_rows"))
        open_ = rolled.where((F.col("depth") == deep) & (F.col("shard_bytes") > limit)).select("prefix")
        last = rolled.where((F.col("depth") == deep) & (F.col("shard_bytes") > limit))
        done = deep
    if done >= BITS:
        found.append(last.select("depth", "prefix", "shard_bytes", "shard_rows"))
    return reduce(DataFrame.unionByName, found)


def shard_name(depth: Column, prefix: Column) -> Column:
    """``s`` and the bits of a bucket; with the letter, no reader of folders takes it for a number."""
    bits = F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0"))
    return F.concat(F.lit("s"), F.when(depth == 0, F.lit("")).otherwise(bits))


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows) for every row.

    Rows are hashed by id. A null text has no bytes; a null id hashes as empty
    text. Rows that repeat an id stay together: if they alone exceed the limit,
    their shard does. A row longer than the limit has a shard that exceeds it,
    with as few others as 60 bits allow. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = staged(rows.withColumn("h", hash_bits(F.col("doc_id"))), "sizes")
    directory = staged(build_directory(rows.select("h", "n_bytes"), limit, step), "directory")
    # A row looks up one prefix for each depth in use; there are at most 61 depths.
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())
    looked = rows.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths)))).withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    return looked.join(lookup(directory), ["depth", "prefix"]).select("doc_id", "n_bytes", shard_name(F.col("depth"), F.col("prefix")).alias("shard"), "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` with a folder for each shard below ``path``; the assignment is returned.

    The folders are named by column shard, or shard_ and so on if ``docs`` has one.
    """
    shards = staged(assign_shards(docs, limit, id_col, text_col), "shards")
    name = "shard"
    while name in docs.columns:
        name += "_"
    named = shards.select(F.col("doc_id").alias("doc_of_shard"), F.col("shard").alias(name)).distinct()
    out = docs.join(named, docs[id_col].eqNullSafe(named["doc_of_shard"])).drop(named["doc_of_shard"])
    out.repartition(F.col(name)).write.partitionBy(name).parquet(path)
    return shards
