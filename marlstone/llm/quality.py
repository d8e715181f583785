"""Quality classification by importance resampling.

Two generative models of hashed word n-grams (unigrams and bigrams in a fixed
number of buckets) are estimated: one from target text, the documents labelled
good, one from all raw text. The importance weight of a document is the ratio of
the two models' probabilities of its text, a product over its n-grams; its log is
the sum of log(target probability / raw probability). Documents are drawn without
replacement by Gumbel top-k: to each log weight a
Gumbel variate is added, and the k largest sums stay (Xie et al., "Data selection
for language models via importance resampling", 2023). The variate comes from a
hash of the id, so a document has the same one at every run and on every machine.

N-grams of one text are far from independent, so log weights of plain products
spread by hundreds and the draw decides little. ``reference`` tempers them: the
weight of a text of n n-grams is raised to the power of reference / n where n is
larger, that is to what so many of its n-grams would give on average. With None
the weight is the plain ratio.

Counting emits one dense vector per task; the driver sees two vectors of the
fixed bucket number. The k-th largest sum is found by narrowing histograms of a
fixed number of bins, exactly, without a global sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import map_arrow, share_package
from .scratch import staged
from .words import WordHashes, chunks, mixed

BUCKETS = 1 << 16
#: Labelled target documents of which the target model is made at most (those of smallest id hash).
TARGET_DOCUMENTS = 50_000
#: Part of the raw model that is mixed into the target model.
SMOOTHING = 0.1
#: N-grams of a text that count as independent evidence; None for the plain ratio.
REFERENCE = 20
_BINS = 1024


def _features(texts: list[bytes], vocabulary: WordHashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the text that each belongs to."""
    parts = [vocabulary.of(text.translate(_FOLD).split()) for text in texts]
    sizes = np.array([len(p) for p in parts])
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])
    same = owner[:-1] == owner[1:]
    both = np.concatenate([words, pairs[same]])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[:-1][same]])


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def target_ids(labels: DataFrame, limit: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids of at most ``limit`` labelled documents of good quality that are not toxic.

    Labels with a null id or null quality are not used. The choice is by a hash
    of the id, so it is the same at every run.
    """
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, limit: int = TARGET_DOCUMENTS, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of every bucket; raw counts are of all documents.

    The target model is mixed with the raw one, so a bucket that the target has
    never seen keeps a finite weight, log(smoothing). Without target text all
    weights are zero.
    """
    # At most ``limit`` ids of eight bytes, whatever the corpus.
    chosen = F.broadcast(target_ids(labels, limit).select(F.col("doc_id").alias("tid")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    rows = rows.join(chosen, F.col("doc_id") == F.col("tid"), "left").select(F.col("tid").isNotNull().alias("target"), "text")
    kinds = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordHashes()
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            marks = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for start, texts in chunks(batch, 1):
                found, owner = _features(texts, vocabulary, buckets)
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[marks[start + owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(target[seen]), pa.array(raw[seen])], schema=kinds)

    counts = map_arrow(rows, run, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for bucket, t, r in counts.collect():  # at most one row per bucket
        target[bucket], raw[bucket] = t, r
    if not target.sum():
        return np.zeros(buckets)
    share = (raw + 1) / (raw.sum() + buckets)
    model = (1 - smoothing) * target / target.sum() + smoothing * share
    return np.log(model / share)


def _weights(texts: list[bytes], vocabulary: WordHashes, table: np.ndarray, reference: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and log weight of each text."""
    found, owner = _features(texts, vocabulary, len(table))
    n = np.bincount(owner, minlength=len(texts))
    ratio = np.bincount(owner, weights=table[found], minlength=len(texts)).astype(np.float64)
    return n, ratio if reference is None else ratio / np.maximum(1, n / reference)


def score(docs: DataFrame, weights: np.ndarray, reference: float | None = REFERENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight) of every row; a null text has no n-grams and weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = WordHashes(), shared.value
        for batch in batches:
            ids = batch.column(0)
            for start, texts in chunks(batch, 1):
                n, values = _weights(texts, vocabulary, table, reference)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(n.astype(np.int64)), pa.array(values)], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_grams long, log_weight double")


def gumbel(key: Column, seed: int | Column) -> Column:
    """A standard Gumbel variate that depends on ``key`` and ``seed`` only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (1 <= k <= rows), by narrowing histograms.

    Each pass counts the values of the open interval in a fixed number of bins
    and goes on with the bin that holds the k-th; the driver sees only counts.
    """
    v = F.col(column)
    low, high = values.agg(F.min(v), F.max(v)).first()
    while low < high:
        width = (high - low) / _BINS
        step = F.least(F.floor((v - low) / width), F.lit(_BINS - 1)) if width > 0 else F.when(v == high, 1).otherwise(0)
        inside = values.where((v >= low) & (v <= high))
        bins = inside.groupBy(step.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy(F.desc("bin")).collect()
        above = values.where(v > high).count()
        for b in bins:
            if above + b["n"] >= k:
                if (b["lo"], b["hi"]) == (low, high):
                    # The bins no longer part the values: the doubles are neighbours.
                    return high if above + inside.where(v == high).count() >= k else low
                low, high = b["lo"], b["hi"]
                break
            above += b["n"]
    return low


def labelled_share(labels: DataFrame, fallback: float = 1.0) -> float:
    """The share of labelled documents whose quality is good; ``fallback`` without labels."""
    row = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()
    return fallback if row[0] is None else row[0]


def _threshold(scored: DataFrame, labels: DataFrame, share: float | None, margin: float) -> float:
    """The smallest gumbel_key that stays."""
    n = scored.count()
    k = min(n, math.ceil(n * min(1.0, (labelled_share(labels) + margin) if share is None else share)))
    return kth_largest(scored, "gumbel_key", k) if k else math.inf


def classify(docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.0, seed: int = 7, reference: float | None = REFERENCE, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """Resample a share of the documents: (doc_id, n_grams, log_weight, gumbel_key, kept).

    The weight is the ratio of the models tempered to ``reference`` n-grams, or
    with None the plain one.
    ``share`` is the part of the rows that stays; without it, it is the part of
    the labelled documents that is good, plus ``margin``. Of n rows k = ceil(n *
    share) stay. Rows with the same gumbel_key as the k-th stay too: that takes
    the same text and the same id. Null texts have weight 0; null ids share one
    variate. An empty table gives an empty result.
    """
    scored = staged(score(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **model), reference, id_col, text_col).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "scores")
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(_threshold(scored, labels, share, margin)))


def keep_good(docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.0, seed: int = 7, reference: float | None = REFERENCE, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all columns.

    The model is fitted and the threshold found as there; then each row is
    scored again where it is read and compared, so no text is shuffled at any
    size. Rows that share an id are judged by their own texts.
    """
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, **model)
    scored = staged(score(docs, weights, reference, id_col, text_col).select((F.col("log_weight") + gumbel(F.col("doc_id"), seed)).alias("gumbel_key")), "scores")
    least = _threshold(scored, labels, share, margin)
    weight = "log_weight"
    while weight in docs.columns:
        weight += "_"
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = WordHashes(), shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.binary())], ["text"])
            for start, some in chunks(texts, 0):
                part = batch.slice(start, len(some))
                _, values = _weights(some, vocabulary, table, reference)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*part.schema.names, weight])

    share_package(docs.sparkSession)
    both = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(weight, DoubleType())]))
    return both.where(F.col(weight) + gumbel(F.col(id_col).cast("long"), seed) >= F.lit(least)).drop(weight)
