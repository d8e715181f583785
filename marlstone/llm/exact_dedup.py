"""Exact deduplication by Patricia tries that own length-and-hash partitions.

Every distinct byte string ends in one terminal node of one trie. Its node
keeps the identifier that stays and the number of rows seen. Each scan task
first folds its own rows through a trie, so a text that fills a third of the
table reaches the shuffle once per task; the folded strings are then dealt by
(byte length, content hash) to the tries that own those partitions. A trie that
outgrows its budget moves its largest subtree to a local spill file, sends later
strings with that prefix there, and rebuilds it on its own at the end, so memory
is bounded by the budget plus one string. Spill files live within one task: a task
that runs again makes its own, and they hold no more than the distinct strings
that this task was dealt.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .scratch import staged

#: Bytes of labels that one trie holds before it spills a subtree.
TRIE_BYTES = 192 << 20


class _Node:
    __slots__ = ("count", "edges", "best", "size")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.count = 0
        self.best: int | None = None
        self.size = 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over byte strings; ``pick`` chooses between two ids."""

    def __init__(self, pick, budget: int = TRIE_BYTES):
        self.pick, self.budget = pick, budget
        self.root = _Node()
        self.held = 0
        self.spilled: dict[bytes, object] = {}

    def add(self, text: bytes, best: int | None, count: int) -> None:
        for prefix, sink in self.spilled.items():
            if text.startswith(prefix):
                pickle.dump((text, best, count), sink, pickle.HIGHEST_PROTOCOL)
                return
        node, at, trail = self.root, 0, []
        while at < len(text):
            found = node.edges.get(text[at])
            if found is None:
                leaf = _Node()
                node.edges[text[at]] = (text[at:], leaf)
                self._grow(trail, node, len(text) - at + 200)
                node, at = leaf, len(text)
                break
            label, child = found
            if text.startswith(label, at):
                trail.append(node)
                node, at = child, at + len(label)
                continue
            cut = _shared(label, text[at : at + len(label)])
            middle = _Node()
            middle.edges[label[cut]] = (label[cut:], child)
            middle.size = child.size + len(label) - cut
            node.edges[text[at]] = (label[:cut], middle)
            self._grow(trail, node, 200)
            trail.append(node)
            node, at = middle, at + cut
        node.best = best if not node.count else self.pick(node.best, best)
        node.count += count
        if self.held > self.budget:
            self._spill()

    def _grow(self, trail: list[_Node], node: _Node, n: int) -> None:
        node.size += n
        for above in trail:
            above.size += n
        self.held += n

    def _spill(self) -> None:
        """Move the largest subtree below the first branching to a file."""
        prefix, parent, node = b"", None, self.root
        while len(node.edges) == 1 and not node.count:
            key, (label, child) = next(iter(node.edges.items()))
            if not child.edges:
                return
            prefix, parent, node = prefix + label, (node, key), child
        branches = {k: v for k, v in node.edges.items() if v[1].edges or len(node.edges) > 1}
        if not branches:
            return
        key = max(branches, key=lambda k: branches[k][1].size + len(branches[k][0]))
        label, child = node.edges.pop(key)
        sink = tempfile.TemporaryFile()
        for item in _walk(child, prefix + label):
            pickle.dump(item, sink, pickle.HIGHEST_PROTOCOL)
        self.spilled[prefix + label[:1]] = sink
        self.held = sum(c.size + len(x) for x, c in node.edges.values())

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Each distinct string with its id and count; spilled subtrees come last."""
        yield from _walk(self.root, b"")
        self.root = _Node()
        for sink in self.spilled.values():
            sink.seek(0)
            # A subtree is rebuilt with room for at least its longest string.
            below = Trie(self.pick, self.budget)
            while True:
                try:
                    text, best, count = pickle.load(sink)
                except EOFError:
                    break
                below.add(text, best, count)
            sink.close()
            yield from below.items()


def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    stack = [(node, prefix)]
    while stack:
        here, text = stack.pop()
        if here.count:
            yield text, here.best, here.count
        stack.extend((child, text + label) for label, child in here.edges.values())


def _picker(keep: str):
    choose = {"smallest": min, "largest": max}[keep]
    return lambda a, b: a if b is None else b if a is None else choose(a, b)


def _fold(keep: str, budget: int):
    """Task function: many (text, id, count) rows to one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(_picker(keep), budget)
        for batch in batches:
            for text, best, count in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                trie.add(text.as_py(), best, count)
        texts: list[bytes] = []
        bests: list[int | None] = []
        counts: list[int] = []
        held = 0
        kinds = pa.schema([("bytes", pa.binary()), ("best", pa.int64()), ("rows", pa.int64())])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(bests, pa.int64()), pa.array(counts, pa.int64())], schema=kinds)

        for text, best, count in trie.items():
            texts.append(text)
            bests.append(best)
            counts.append(count)
            held += len(text)
            if held > 8 << 20:
                yield out()
                texts, bests, counts, held = [], [], [], 0
        if texts:
            yield out()

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: (text_sha256, keep_id, group_size).

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    Texts are equal if their UTF-8 bytes are; null counts as the empty text. A
    null id never wins over another; if all ids of a group are null, keep_id is.
    """
    rows = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("bytes"), F.col(id_col).cast("long").alias("best"), F.lit(1).cast("long").alias("rows"))
    kinds = "bytes binary, best long, rows long"
    folded = map_arrow(rows, _fold(keep, budget), kinds)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = map_arrow(folded.repartition(parts, F.length("bytes"), F.xxhash64("bytes")), _fold(keep, budget), kinds)
    return owned.select(F.sha2("bytes", 256).alias("text_sha256"), F.col("best").alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """Mark every row of ``docs`` with its group: (doc_id, keep_id, group_size, kept, text_sha256).

    Ids are expected to be unique; rows that repeat the id that stays are all
    marked as kept. Rows of a group whose ids are all null are kept. Empty
    tables give empty results; other columns of ``docs`` are not read.
    """
    groups = staged(duplicate_groups(docs, id_col, text_col, keep, budget).where("group_size > 1"), "exact-groups")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
