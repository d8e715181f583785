"""Document fingerprints: a digest of bucket quartiles, and the likeness of two digests.

Every run of three bytes of a text is hashed into one of 512 buckets. A bucket's
count is written as the quartile of the counts it falls into, two bits a bucket,
behind the logarithm of the length. Texts that share much have buckets in the
same quartiles, wherever the shared passages stand (Oliver, Cheng and Chen,
"TLSH, a locality sensitive hash", 2013). The difference of two digests is the
sum of their buckets' steps and the step between their lengths, up to a bound:
what unrelated texts hardly reach, or less where the two hold less.

A report compares each document with the one of the next id. Documents are
shuffled once, by ranges of ids, and each task lays neighbours against each
other; what remains are the ends of the ranges, one text at each, which are
joined range to range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .scratch import staged

BUCKETS = 512
#: Multiplier whose product's top bits are a triplet's bucket.
TRIPLET_MIX = 2654435761
_SHIFT = 32 - BUCKETS.bit_length() + 1
#: Steps of the length for each doubling, and the most that lengths add to a difference.
LENGTH_STEPS = 8
LENGTH_BOUND = 32
#: The most that buckets add to a difference. Those of unrelated texts differ by 1.25 steps on average.
BOUND = BUCKETS * 3 // 2
_BLOCK = 1 << 20


def bucket_codes(data: bytes) -> np.ndarray:
    """The quartile, 0 to 3, of each bucket; all 0 for fewer than three bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for begin in range(0, max(0, len(data) - 2), _BLOCK):
        a = np.frombuffer(data[begin : begin + _BLOCK + 2], np.uint8).astype(np.uint32)
        triplets = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
        counts += np.bincount(triplets * np.uint32(TRIPLET_MIX) >> np.uint32(_SHIFT), minlength=BUCKETS)
    low, middle, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts > low).astype(np.int8) + (counts > middle) + (counts > high)


@dataclass
class Digest:
    """Quartiles of the buckets and the step of the length."""

    codes: np.ndarray
    length: int

    @classmethod
    def of(cls, data: bytes) -> Digest:
        return cls(bucket_codes(data), min(255, int(np.floor(LENGTH_STEPS * np.log2(len(data) + 1)))))

    @classmethod
    def parse(cls, text: str) -> Digest:
        digits = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
        return cls(np.stack([digits >> s & 3 for s in (6, 4, 2, 0)], 1).ravel().astype(np.int8), int(text[:2], 16))

    def __str__(self) -> str:
        four = self.codes.reshape(-1, 4).astype(np.uint8)
        return f"{self.length:02x}" + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes().hex()

    def difference(self, other: Digest) -> tuple[int, int]:
        """The difference of two digests, and the bound that it cannot pass."""
        steps = int(np.abs(self.codes - other.codes).sum())
        bound = min(BOUND, int(self.codes.sum()) + int(other.codes.sum())) + LENGTH_BOUND
        return min(bound, steps + min(LENGTH_BOUND, abs(self.length - other.length))), bound

    def likeness(self, other: Digest) -> float:
        """1 for equal digests, 0.2 or less for most unrelated ones, 0 at least."""
        steps, bound = self.difference(other)
        return 1 - steps / bound


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, in place; a null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [str(Digest.of(cell.as_py())) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], schema=kinds)

    return map_arrow(rows, run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DONE, _HEAD, _TAIL = 0, 1, 2
_ENDS = pa.schema([*_KINDS, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])
#: Rows that a task holds before it hands them on.
_ROWS = 1024


def _compared(doc_id: int | None, text: str, own: Digest, following: str, other: Digest) -> tuple:
    changed = edited(text, following).encode()
    digest = Digest.of(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), str(own), str(digest), own.likeness(digest), own.likeness(other)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row (doc_id, text, part) with the next; the first and last text of a part are handed on."""
    held: list[tuple] = []
    before: tuple | None = None
    for batch in batches:
        for cells in zip(*batch.columns, strict=True):
            doc_id, text, part = (c.as_py() for c in cells)
            own = Digest.of(text.encode())
            if before is None:
                held.append((doc_id, *[None] * 6, part, _HEAD, text))
            else:
                held.append((*_compared(*before[:3], text, own), part, _DONE, None))
            before = (doc_id, text, own, part)
            if len(held) >= _ROWS:
                yield _batch(held, _ENDS)
                held = []
    if before:
        held.append((before[0], *[None] * 6, before[3], _TAIL, before[1]))
        yield _batch(held, _ENDS)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare rows (doc_id, text, following)."""
    for batch in batches:
        for cells in zip(*batch.columns, strict=True):
            doc_id, text, following = (c.as_py() for c in cells)
            yield _batch([_compared(doc_id, text, Digest.of(text.encode()), following, Digest.of(following.encode()))], _KINDS)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How alike each document is to an edited copy and to the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row a document. The edited copy has the last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the
    document of the next id; after the last comes the first, and a single
    document follows itself. Null texts count as empty. Null ids come first;
    rows that share an id are ordered by a hash of their texts. Equal texts have
    equal fingerprints. An empty table gives an empty result; other columns play
    no part.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    order = [F.asc_nulls_first("doc_id"), F.asc("th")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = staged(map_arrow(sorted_rows.select("doc_id", "text", F.spark_partition_id().alias("part")), _neighbours, _OUT + ", part int, kind int, text string"), "neighbours")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = found.where(F.col("kind") == _TAIL).select("part", "doc_id", "text")
    numbers = sorted(r[0] for r in heads.select("next").collect())  # one a range
    steps = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "part int, next int")
    ends = tails.join(F.broadcast(steps), "part").join(heads, "next").select("doc_id", "text", "following")
    done = found.where(F.col("kind") == _DONE).select(*_KINDS.names)
    return done.unionByName(map_arrow(ends, _finish, _OUT))
