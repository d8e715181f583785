"""Resampling towards a target distribution, with long texts cut into chunks.

Features of a text are its runs of one to ``max_n`` words, hashed into buckets.
A bucket's gain is the log of how much likelier it is in the target texts than
in the raw ones; a document's weight is the mean gain of its features. A Gumbel
variate of the id is added, and the documents with the largest sums are drawn
(Xie et al., "Data selection for language models via importance resampling",
2023).

Texts are skewed: a few may be thousands of times longer than the others. Those
are cut at word boundaries into chunks that carry the next ``max_n - 1`` words,
and the chunks are spread over all tasks. A chunk owns the features that start in
it, so each feature is counted once; counts and gains of chunks are summed by
document. Gains are whole numbers, so sums do not depend on their order.

Drawn documents are ranked by a range shuffle of ids and scores and the sizes of
its parts, not in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .quality import kth_largest
from .scratch import discard, staged
from .words import chunks, cut_words

BUCKETS = 10_000
#: Bytes beyond which a text is cut, and bytes of its chunks.
LONG_BYTES = 1 << 18
CHUNK_BYTES = 1 << 17

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _features(owned: list[list[bytes]], carried: list[list[bytes]], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of words that starts in the owned words, and the chunk it belongs to."""
    words: list[bytes] = []
    for own, more in zip(owned, carried, strict=True):
        words += own
        words += more
    sizes = np.array([len(own) + len(more) for own, more in zip(owned, carried, strict=True)], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(owned)), sizes)
    starts = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owns = starts < np.repeat(np.array([len(own) for own in owned], np.int64), sizes)
    spaced = [b" " + w for w in words]
    sums = list(map(crc32, words))
    found, whose = [], []
    for n in range(1, max_n + 1):
        if n > 1:
            # The checksum of a run goes on from that of the run without its last word.
            sums = list(map(crc32, spaced[n - 1 :], sums))
        values = np.array(sums, np.int64)
        at = np.arange(len(values))
        inside = owns[: len(values)] & (at + n <= ends[: len(values)])
        found.append(values[inside] % buckets)
        whose.append(owner[: len(values)][inside])
    return np.concatenate(found), np.concatenate(whose)


def _key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("k2")]


def _is_long(text_col: str, limit: int) -> Column:
    return F.coalesce(F.octet_length(text_col) > limit, F.lit(False))


def text_chunks(docs: DataFrame, carry: int, size: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, no, own, carried) of every text, spread over tasks: its chunks, folded, words between spaces.

    The rows of one id and text give the same chunks twice. A null text gives none.
    """
    rows = docs.select(*_key(id_col, text_col), F.encode(F.col(text_col), "UTF-8").alias("text")).where("text is not null")
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("no", pa.int32()), ("own", pa.binary()), ("carried", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, cell in zip(*(batch.column(i) for i in range(3)), strict=True):
                for no, (own, more) in enumerate(cut_words(cell.as_py().translate(_FOLD), size, carry)):
                    yield pa.RecordBatch.from_arrays([pa.array([k1.as_py()]), pa.array([k2.as_py()]), pa.array([no], pa.int32()), pa.array([own], pa.binary()), pa.array([more], pa.binary())], schema=kinds)

    return map_arrow(rows, run, "k1 long, k2 long, no int, own binary, carried binary").repartition("k1", "no")


def _short(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, own) of the texts that are not cut."""
    return docs.where(~_is_long(text_col, limit)).select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("own"))


def _words(batch: pa.RecordBatch, own: int, carried: int | None) -> Iterator[tuple[int, list[list[bytes]], list[list[bytes]]]]:
    """Runs of rows: (first row, owned words, carried words)."""
    for start, texts in chunks(batch, own):
        more = [batch.column(carried)[start + i].as_py().split() for i in range(len(texts))] if carried is not None else [[] for _ in texts]
        yield start, [t.translate(_FOLD).split() for t in texts], more


def bucket_counts(docs: DataFrame, max_n: int = 2, buckets: int = BUCKETS, limit: int = LONG_BYTES, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver sees one row a bucket at most."""
    kinds = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def counter(own: int, carried: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                for _, words, more in _words(batch, own, carried):
                    total += np.bincount(_features(words, more, max_n, buckets)[0], minlength=buckets)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=kinds)

        return run

    short = map_arrow(_short(docs, limit, id_col, text_col), counter(1, None), "bucket int, n long")
    cut = text_chunks(docs.where(_is_long(text_col, limit)), max_n - 1, id_col=id_col, text_col=text_col)
    found = short.unionByName(map_arrow(cut, counter(3, 4), "bucket int, n long"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[bucket] = n
    return total


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the raw text)) of each bucket, one added to every count."""
    buckets = len(raw)
    t_all, s_all = int(target.sum()) + buckets, int(raw.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def _weighed(docs: DataFrame, gains: np.ndarray, max_n: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, gain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    buckets = len(gains)

    def weigher(own: int, carried: int | None, keys: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                for start, words, more in _words(batch, own, carried):
                    found, owner = _features(words, more, max_n, buckets)
                    n = np.bincount(owner, minlength=len(words)).astype(np.int64)
                    # Whole numbers far below 2**53, so the sum of doubles is exact.
                    gain = np.bincount(owner, weights=table[found], minlength=len(words)).astype(np.int64)
                    sizes = pa.array([len(w) for w in words], pa.int64())
                    given = [batch.column(i).slice(start, len(words)) for i in range(keys)]
                    names = [*batch.schema.names[:keys], "n_words", "n_features", "gain"]
                    yield pa.RecordBatch.from_arrays([*given, sizes, pa.array(n), pa.array(gain)], names=names)

        return run

    kind = "n_words long, n_features long, gain long"
    short = map_arrow(_short(docs, limit, id_col, text_col), weigher(1, None, 1), "doc_id long, " + kind)
    long = docs.where(_is_long(text_col, limit))
    cut = map_arrow(text_chunks(long, max_n - 1, id_col=id_col, text_col=text_col), weigher(3, 4, 3), "k1 long, k2 long, no int, " + kind)
    sums = cut.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")), F.sum((F.col("no") == 0).cast("long")).alias("copies"))
    sums = sums.select("k1", "k2", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "gain")))
    rows = long.select(F.col(id_col).cast("long").alias("doc_id"), *_key(id_col, text_col))
    return short.unionByName(rows.join(sums, ["k1", "k2"]).select("doc_id", "n_words", "n_features", "gain"))


def gumbel_thousandths(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u being the first 32 bits of sha256("seed:id"); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with rank 1 to k by score descending, then doc_id, and null for what comes after.

    Parts of a range shuffle are numbered and written; the driver sees one count
    a part and gives each the number of rows before it.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = staged(placed.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    shifts = rows.sparkSession.createDataFrame(offsets, "p long, shift long")
    rank = F.col("shift") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    placed = placed.withColumn("p", part).join(F.broadcast(shifts), "p").withColumn("rank", rank)  # one row a part
    return placed.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("p", "place", "shift")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, max_n: int = 2, buckets: int = BUCKETS, seed: int = 7, long_bytes: int = LONG_BYTES, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id") -> DataFrame:
    """Draw documents like the target texts: (doc_id, n_features, weight, score, rank), one row a document.

    Of the N documents with ``min_words`` words or more, floor(percent * N / 100)
    with the highest scores are drawn and ranked from 1, ties to the smaller id
    (null first); rows that also share the id come in any order. The rest has a
    null rank. weight is the mean gain, rounded down, and 0 for a text without
    words, as a null or empty one. Texts of more than ``long_bytes`` are cut into
    chunks. Empty tables are allowed on either side; other columns play no part.
    """
    gains = bucket_gains(
        bucket_counts(target, max_n, buckets, long_bytes, target_id_col, text_col),
        bucket_counts(docs, max_n, buckets, long_bytes, id_col, text_col),
    )
    # Rounded down, also below zero; div rounds towards zero.
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    scored = _weighed(docs, gains, max_n, long_bytes, id_col, text_col).withColumn("weight", mean.cast("long"))
    scored = staged(scored.withColumn("score", F.col("weight") + gumbel_thousandths(F.col("doc_id"), seed)), "weighed")
    enough = scored.where(F.col("n_words") >= min_words)
    k = percent * enough.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, unranked)
    least = int(kth_largest(enough, "score", k))
    top = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    ranked = _ranked(scored.where(top).select(*out), k)
    return ranked.select(*out, "rank").unionByName(scored.where(~top).select(*out, unranked))
