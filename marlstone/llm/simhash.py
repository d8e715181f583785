"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so a pair within Hamming distance r lies within Manhattan
distance r. The axes are cut into g groups; of a pair in range at least g - r
groups have no difference at all, so the two points share a unit grid cell in
the projection on some g - r groups. The range join therefore deals each point
to its cell in every such projection and compares only within cells: first the
Manhattan bound, then the exact Hamming distance.

Counts 0, 1, 2 are held in unary in the segment's own two bits, which makes the
Manhattan distance a popcount of an exclusive or.

Fingerprints are made distinct before the join, cells emit a spanning forest
and no pairs, and cells that outgrow a task are compared block against block in
tasks of their own. Classes are connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .components import connected_components
from .scratch import discard, lookup, staged

#: Points of one cell that one task compares; larger cells go block against block.
CELL_POINTS = 16_384
#: Cells up to this size are compared all at once over a whole batch.
SMALL_CELL = 24
#: Measured costs of a shuffled row, a step through a large cell, and a comparison.
ROW_NS, WALK_NS, COMPARE_NS = 2_000, 10_000, 3

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit number.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles of words are
    joined by one space and hashed with XXH64; a bit is set if it is set in over
    half of the hashes. Fewer words than a shingle make one shingle, none make 0.
    """
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty."""
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [simhash(cell.as_py() or b"", shingle) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], schema=kinds)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")), run, "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding of uint64 fingerprints: bit counts of two-bit segments, in unary."""
    odd = np.uint64(0x5555555555555555)
    low, high = fp & odd, (fp >> np.uint64(1)) & odd
    return (low | high) | ((low & high) << np.uint64(1))


def projections(groups: int, radius: int) -> list[int]:
    """Bit masks of the unary embedding, one for each choice of ``groups - radius`` axis groups."""
    edges = [2 * round(32 * i / groups) for i in range(groups + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(groups)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(groups), groups - radius)]


def grid_groups(points: int, radius: int) -> int:
    """The number of axis groups of least cost; every choice finds all pairs.

    A point costs each projection a shuffled row, a walk through its cell unless
    that is small, and a comparison with each stranger in it. Two-bit counts of
    random fingerprints agree with probability 3/8.
    """

    def cost(groups: int) -> float:
        strangers = points * 0.375 ** (32 * (groups - radius) / groups)
        return comb(groups, radius) * (ROW_NS + (WALK_NS if strangers > SMALL_CELL else 0) + COMPARE_NS * strangers)

    return min(range(radius + 1, radius + 9), key=cost)


def _close(fp: np.ndarray, un: np.ndarray, one_fp, one_un, radius: int) -> np.ndarray:
    """Which points are in range: the Manhattan bound first, then the exact distance."""
    near = np.flatnonzero(np.bitwise_count(un ^ one_un) <= radius)
    return near[np.bitwise_count(fp[near] ^ one_fp) <= radius]


def _forest(fp: np.ndarray, un: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links within one cell, breadth first over what is unvisited."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            found = _close(fp[rest], un[rest], fp[x], un[x], radius)
            if len(found):
                hit = rest[found]
                a.append(np.full(len(hit), fp[x]))
                b.append(fp[hit])
                queue.extend(hit.tolist())
                rest = np.delete(rest, found)
    return a, b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("p", pa.int32()), ("cell", pa.int64()), ("block", pa.int64())])


def _cells(radius: int, limit: int):
    """Compare points of equal leading columns in rows sorted by those columns.

    Input (p, cell, x, y, fp); output links, and from cells over ``limit`` their
    points by block, for a second round.
    """

    def rows(a, b=None, p=None, cell=None, block=None) -> pa.RecordBatch:
        n = len(a)
        full = lambda v, t: pa.nulls(n, t) if v is None else pa.array(np.full(n, v) if np.isscalar(v) else v, t)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), full(None if b is None else b.view(np.int64), pa.int64()), full(p, pa.int32()), full(cell, pa.int64()), full(block, pa.int64())], schema=_LINKS)

    def compare(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        un = unary(fp)
        fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(fresh, len(fp)))
        run = np.repeat(np.arange(len(fresh)), sizes)
        small = np.flatnonzero((sizes[run] <= SMALL_CELL) & (sizes[run] > 1))
        a, b = [], []
        for step in range(1, SMALL_CELL):
            at = small[small + step < len(fp)]
            small = at = at[run[at] == run[at + step]]
            if not len(at):
                break
            at = at[np.bitwise_count(un[at] ^ un[at + step]) <= radius]
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            a.append(fp[at])
            b.append(fp[at + step])
        for k in np.flatnonzero(sizes > SMALL_CELL):
            some = slice(fresh[k], fresh[k] + sizes[k])
            more_a, more_b = _forest(fp[some], un[some], radius)
            a += more_a
            b += more_b
        if a and len(x := np.concatenate(a)):
            pairs = np.unique(np.stack([x, np.concatenate(b)]), axis=1)
            yield rows(np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        over, block = None, 0
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(columns[:4], axis=1).astype(np.int64)])
            fp = np.concatenate([fp, columns[4].astype(np.int64).view(np.uint64)])
            # The last cell may go on in the next batch.
            last = len(fp) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
            if over is not None and (keys[0] == over).all():
                same = int(np.argmin((keys == over).all(axis=1))) if not (keys == over).all() else len(fp)
                yield rows(fp[:same], p=int(over[0]), cell=int(over[1]), block=block + np.arange(same) // max(1, limit // 2))
                block += -(-same // max(1, limit // 2))
                keys, fp, last = keys[same:], fp[same:], max(0, last - same)
                if not len(fp):
                    continue
            over = None
            if last:
                yield from compare(keys[:last], fp[:last])
                keys, fp = keys[last:], fp[last:]
            if len(fp) > limit:
                over, block = keys[0].copy(), -(-len(fp) // max(1, limit // 2))
                yield rows(fp, p=int(over[0]), cell=int(over[1]), block=np.arange(len(fp)) // max(1, limit // 2))
                keys, fp = keys[:0], fp[:0]
        if len(fp) and not (over is not None and (keys[0] == over).all()):
            yield from compare(keys, fp)

    return task


def links_within(distinct: DataFrame, radius: int = 4, limit: int = CELL_POINTS, groups: int | None = None) -> DataFrame:
    """Links (a, b) that connect exactly the classes of fingerprints within ``radius`` bits.

    ``distinct`` has distinct fingerprints in column fp. Every link holds, and
    any pair in range is joined by a path of links.
    """
    spark = distinct.sparkSession
    groups = groups or grid_groups(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in projections(groups, radius)]
    fp = F.col("fp")
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    un = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = distinct.select("fp", un.alias("un")).select("fp", "un", F.posexplode(F.array(*(F.lit(m) for m in signed))).alias("p", "mask"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(0).cast("long")
    cells = cells.select(F.col("p").cast("int").alias("p"), F.col("un").bitwiseAND(F.col("mask")).alias("cell"), zero.alias("x"), zero.alias("y"), "fp")
    kinds = "a long, b long, p int, cell long, block long"
    order = ["p", "cell", "x", "y"]
    first = staged(map_arrow(cells.repartition(parts, *order).sortWithinPartitions(*order), _cells(radius, limit), kinds), "cell-links")
    links = first.where("b is not null").select("a", "b")
    over = first.where("b is null").select("p", "cell", "block", F.col("a").alias("fp"))
    if over.limit(1).count():
        size = over.groupBy("p", "cell").agg((F.max("block") + 1).alias("blocks"))
        dealt = over.join(size, ["p", "cell"]).select("p", "cell", "block", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("p", "cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp")
        second = map_arrow(dealt.repartition(parts, *order).sortWithinPartitions(*order), _cells(radius, 1 << 62), kinds)
        links = links.unionByName(staged(second, "block-links").select("a", "b"))
    return links


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", limit: int = CELL_POINTS, groups: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest id reachable over links, the row's own included. Null texts count
    as empty, empty texts have fingerprint zero and link like any other. A null
    id is never smallest; a class of null ids only has a null component_id. Rows
    that repeat an id are judged by their own texts. Other columns are not read.
    """
    marked = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "distinct-fingerprints")
    roots = connected_components(links_within(distinct, radius, limit, groups))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "c", "root")
    linked = own.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only classes of more than one row need a look-up; a row alone is its own class.
    classes = linked.join(least, "root").select("fp", "component_id").unionByName(own.where("root is null and c > 1").select("fp", F.col("least").alias("component_id")))
    classes = staged(classes, "classes").withColumn("grouped", F.lit(True))
    discard(distinct)
    out = marked.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their class, with all columns.

    Rows that repeat the smallest id all stay, as do classes of null ids only.
    The ids that go are joined, not those that stay: they are fewer, and while
    they may be broadcast the texts are not shuffled.
    """
    classes = simhash_components(docs, id_col=id_col, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = staged(classes.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("not stays").select(F.col("doc_id").alias("gone_id")), "dropped-ids")
    return docs.join(lookup(gone), docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")
