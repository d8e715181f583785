"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: every window of ``length`` words chooses the
leftmost of its word n-grams with the smallest hash, so equal windows choose the
same anchor at the same offset, and about one word in fourteen is an anchor. The
windows that choose one anchor follow each other and form a run.

1. Anchors are joined on their hash; only those that occur twice go on.
2. Each such anchor is extended to both sides as far as its run of windows goes.
   Runs with equal words are repeats as a whole, however many copies there are.
3. Anchors that also stand in differing runs are extended window by window, one
   representative for each distinct run, which finds where a repeat ends.
4. Overlapping repeats of a document merge to maximal ones and are cut out.

No step makes pairs of occurrences: groups are counted with partial aggregates,
so a passage in a third of all documents costs as much as its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .scratch import discard, staged
from .words import Rolling, WordHashes, chunks

#: Words of an anchor.
ANCHOR = 8
#: Rows of representatives that may be broadcast (24 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 400_000


def _runs(texts: list[bytes], vocabulary: WordHashes, length: int, anchor: int):
    """Anchor runs of a chunk: rolling hashes, first word of each text, and per run
    (text, anchor hash, first window, anchor offset, number of windows)."""
    counts, parts = [], []
    for text in texts:
        words = text.split()
        counts.append(len(words))
        parts.append(vocabulary.of(words))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    rolling = Rolling(words)
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return rolling, firsts, (none, none.astype(np.uint64), none, none, none)
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(words) - anchor + 1)
    grams = rolling.runs(at, at + anchor)
    # Leftmost position of the smallest n-gram in spans of doubling width.
    best, width, span = at, 1, length - anchor + 1

    def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(grams[left] <= grams[right], left, right)

    while 2 * width <= span:
        best = merge(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = merge(best[: len(best) - (span - width)], best[span - width :])
    whole = doc[:n] == doc[length - 1 :]
    starts = np.flatnonzero(whole)
    chosen = best[starts]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return rolling, firsts, (none, none.astype(np.uint64), none, none, none)
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
    begin, seed = starts[fresh], chosen[fresh]
    number = np.diff(np.append(fresh, len(starts)))
    return rolling, firsts, (doc[begin], grams[seed], begin, seed - begin, number)


def _anchors(length: int, anchor: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            for start, texts in chunks(batch, 1):
                _, _, (doc, h, *_rest) = _runs(texts, vocabulary, length, anchor)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + start)), pa.array(h.view(np.int64))], schema=kinds)

    return run


_RUN = "doc_id long, th long, s0 int, off int, n int, h long, span long, wins array<long>"


def _extend(length: int, anchor: int):
    """Runs whose anchor hash is in the list that comes with each text."""
    kinds = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s0", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("span", pa.int64()), ("wins", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordHashes()
        for batch in batches:
            ids, hashes, wanted = batch.column(0), batch.column(1), batch.column(3)
            for start, texts in chunks(batch, 2):
                rolling, firsts, (doc, h, s0, off, n) = _runs(texts, vocabulary, length, anchor)
                lists = wanted.slice(start, len(texts))
                owner = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths().fill_null(0)))
                # A hash listed for one text may also mark another's run; that only costs a later comparison.
                keep = np.flatnonzero(np.isin(h.view(np.int64), np.asarray(lists.flatten()))) if len(owner) else np.zeros(0, np.int64)
                doc, h, s0, off, n = doc[keep], h[keep], s0[keep], off[keep], n[keep]
                edges = np.concatenate([[0], np.cumsum(n)])
                flat = np.arange(edges[-1]) - np.repeat(edges[:-1] - s0, n)
                wins = rolling.runs(flat, flat + length).view(np.int64)
                span = rolling.runs(s0, s0 + n - 1 + length).view(np.int64)
                rows = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), *(pa.array(x.astype(np.int32)) for x in (s0 - firsts[doc], off, n)), pa.array(h.view(np.int64)), pa.array(span), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(wins))],
                    schema=kinds,
                )

    return run


def _cut(with_text: bool):
    """Remove the words of the given intervals."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    kinds = pa.schema(fields + ([("kept_text", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = batch.column(0), batch.column(2)
            total, gone, digest, kept = [], [], [], []
            for i, cell in enumerate(batch.column(1)):
                words = (cell.as_py() or b"").split()
                total.append(len(words))
                removed = 0
                if len(found := cuts[i].values or ()):
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, np.asarray(found.field(0)), 1)
                    np.add.at(depth, np.asarray(found.field(1)), -1)
                    stays = np.cumsum(depth[:-1]) == 0
                    removed = len(words) - int(stays.sum())
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                text = b" ".join(words)
                gone.append(removed)
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode())
            columns = [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if with_text else []), schema=kinds)

    return run


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, anchor: int = ANCHOR) -> DataFrame:
    """Remove each word covered by a ``length``-word window whose words also start anywhere else.

    Windows are judged on the input, not on what is left, so every copy goes.
    Returns per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by
    a space) and with ``with_text`` kept_text. Null texts have no words. Rows
    that repeat an id are separate documents; a null id is passed through.
    Texts shorter than a window lose nothing. Other columns are not read.
    """
    anchor = min(anchor, length)
    # The hash of the text keeps apart rows that share an id.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    anchors = staged(map_arrow(rows.select("doc_id", "text"), _anchors(length, anchor), "doc_id long, h long"), "anchors")
    repeated = staged(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeated-anchors")
    wanted = anchors.join(repeated, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("wanted"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"])
    sought = rows.join(wanted, same(rows, wanted)).select(rows["doc_id"], "th", "text", "wanted")
    runs = staged(map_arrow(sought, _extend(length, anchor), _RUN), "runs")
    discard(anchors, repeated)

    key = ["h", "off", "n", "span"]
    distinct = staged(runs.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "s0")).alias("rep")), "distinct-runs")
    copied = distinct.where("c > 1").select(*key)
    whole = runs.select("doc_id", "th", "s0", *key).join(copied, key, "left_semi").select("doc_id", "th", "s0", (F.col("s0") + F.col("n") - 1 + length).alias("end"))
    mixed = distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("h")
    # Written on its own, so that a join on a common anchor can be split.
    mixed = staged(mixed, "mixed-anchors")
    needed = staged(distinct.join(mixed, "h", "left_semi").select("rep.doc_id", "rep.th", "rep.s0", "c"), "representatives")
    few = needed.count() <= BROADCAST_ROWS
    reps = (F.broadcast(needed) if few else needed).select(F.col("doc_id").alias("rd"), F.col("th").alias("rt"), F.col("s0").alias("rs"), "c")
    part = runs.select("doc_id", "th", "s0", "off", "h", "wins").join(reps, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt")) & (F.col("s0") == F.col("rs")))
    windows = part.select("doc_id", "th", "s0", "off", "h", "c", F.posexplode("wins").alias("i", "w")).select("doc_id", "th", (F.col("s0") + F.col("i")).alias("s"), "c", "h", (F.col("off") - F.col("i")).alias("o"), "w")
    windows = staged(windows, "windows")
    shared = staged(windows.groupBy("h", "o", "w").agg(F.count("*").alias("k")).where("k > 1").select("h", "o", "w"), "shared-windows")
    edge = windows.where("c = 1").join(shared, ["h", "o", "w"], "left_semi").select("doc_id", "th", F.col("s").alias("s0"), (F.col("s") + length).alias("end"))
    cuts = whole.unionByName(edge).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s0", "end")).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("cd"), F.col("th").alias("ct"), "cuts")
    out = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("th") == F.col("ct")), "left").select("doc_id", "text", "cuts")
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_arrow(out, _cut(with_text), kinds)
