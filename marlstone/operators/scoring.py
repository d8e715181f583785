"""Sums over common terms of many queries and all documents, made in tasks.

A document is a row with its terms, so counting them shuffles nothing. Queries are
written to the shared folder in blocks; a task lays each chunk of its documents
against one block after the other and lets go only what may be among the k best
of a query. Pairs of query and document are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from ..staging import staged

#: Queries and distinct terms of one file, and documents that are laid against a block at once.
BLOCK_QUERIES, BLOCK_TERMS, CHUNK = 256, 500_000, 2048
#: Tokens that are counted at once; terms of those documents, and numbers of their matrix, so that long texts do not take more memory.
CHUNK_TOKENS, CHUNK_TERMS, CHUNK_VALUES = 1_000_000, 250_000, 4_000_000
#: Terms of the rows that a task gets to add up.
TASK_TERMS = 2_000_000
#: A term that at least this share of a block's queries has goes through a matrix, others through their queries.
COMMON = 1 / 16

#: From sums (documents by queries), the documents' n and the queries' m to scores.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _files(rows: DataFrame, label: str, per_file: int) -> list[str]:
    """Names of files of about ``per_file`` rows that every task can read."""
    rows = staged(rows, label)
    return staged(rows.repartition(max(1, -(-rows.count() // per_file))), label).inputFiles()


def _read(file: str) -> pa.Table:
    store, path = pafs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        return pq.read_table(source).combine_chunks()


def _one_by_one(files: list[str], make: Callable[[pa.Table], object]) -> Callable[[str], object]:
    """Reads what was made of a file; the last one is held."""
    held: dict[str, object] = {}

    def get(file: str) -> object:
        if file not in held:
            held.clear()
            held[file] = make(_read(file))
        return held[file]

    return get


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of values among the known ones, -1 for others."""
    return pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)


def _owners(lists: pa.Array) -> np.ndarray:
    """For every value of the lists the number of its list."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _parts(lists: pa.Array, rows: int, values: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of at most so many lists and values in all, of one list at least."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + values, side="right"))))
        yield start, end - start
        start = end


def counted(docs: DataFrame, terms: DataFrame | None, key: str, tokens: Column, *more: Column) -> DataFrame:
    """(key, dl, n, terms, tfs) for every row: its tokens, its distinct tokens, and how often it has the wanted ``terms`` (term), or any if these are None.

    ``more`` are further columns of the rows, which come behind n.
    """
    files = None if terms is None else _files(terms.select("term").where("term is not null").distinct(), "asked-terms", BLOCK_TERMS)
    rows = docs.select(F.col(key).alias("key"), *more, tokens.alias("tokens"))
    rows = rows.select("key", F.size("tokens").alias("dl"), F.size(F.array_distinct("tokens")).alias("n"), *rows.columns[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _one_by_one(files or [], lambda t: _column(t, "term"))
        for batch in (x.slice(*part) for x in batches for part in _parts(x.columns[-1], len(x), CHUNK_TOKENS)):
            tokens = batch.columns[-1]
            flat, owner = tokens.flatten(), _owners(tokens)
            found = []
            for known in [flat.unique()] if files is None else map(wanted, files):
                code = _codes(flat, known)
                pair, tf = np.unique(owner[code >= 0] * max(1, len(known)) + code[code >= 0], return_counts=True)
                found.append((pair // max(1, len(known)), known.take(pa.array(pair % max(1, len(known)))), tf))
            row = np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)])
            word = pa.concat_arrays([x[1] for x in found]) if found else pa.array([], pa.string())
            tf = np.concatenate([x[2] for x in found] or [np.zeros(0, np.int64)])
            order = np.argsort(row, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, word.take(pa.array(order)).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tf[order], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=names)

    names = [*rows.columns[:-1], "terms", "tfs"]
    return map_arrow(rows, run, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:-1]) + ", terms array<string>, tfs array<int>")


def _added(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows (..., terms, values) those that are equal before terms in one, in the order of the first ones; values of equal terms are summed."""
    group = np.zeros(len(batch), np.int64)
    for column in batch.columns[:-2]:
        code = column.dictionary_encode("encode")
        group = np.unique(group * max(1, len(code.dictionary)) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    group = np.argsort(np.argsort(first))[group]
    terms, values = batch.columns[-2:]
    code = terms.flatten().dictionary_encode()
    width = max(1, len(code.dictionary))
    pair, place = np.unique(group[_owners(terms)] * width + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    sums = np.bincount(place, weights=values.flatten().to_numpy(zero_copy_only=False), minlength=len(pair))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pair // width, minlength=len(first)))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, x, type=c.type) for x, c in ((code.dictionary.take(pa.array(pair % width)), terms), (pa.array(sums), values))]
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(np.sort(first))) for c in batch.columns[:-2]), *lists], schema=batch.schema)


def added_up(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (*by, terms, values), those of equal ``by`` in one, values of equal terms summed.

    Tasks add up what they read before it is shuffled, so a group of very many rows
    is no more than one of each batch there; groups come sorted to the tasks that
    end them, which hold one batch and one group.
    """
    rows = rows.select(*by, "terms", F.col("values").cast("array<double>").alias("values"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.columns[-2], len(batch), CHUNK_TERMS):
                yield _added(batch.slice(*part))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in (x.slice(*part) for x in batches for part in _parts(x.columns[-2], len(x), CHUNK_TERMS)):
            done = _added(batch if last is None else pa.concat_batches([last, batch]))
            yield done.slice(0, len(done) - 1)
            last = done.slice(len(done) - 1)
        if last is not None:
            yield last

    terms = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    few = map_arrow(rows, before, schema).repartition(max(1, -(-terms // TASK_TERMS)), *by)
    return map_arrow(few.sortWithinPartitions(*by), after, schema)


class _Block:
    """Queries with their weighted terms."""

    def __init__(self, table: pa.Table):
        self.ids, self.m = _column(table, "query_id"), _column(table, "m").to_numpy(zero_copy_only=False)
        lists = _column(table, "terms")
        flat, owner = lists.flatten(), _owners(lists)
        weight = _column(table, "weights").flatten().to_numpy(zero_copy_only=False)
        self.known = flat.unique()
        code = _codes(flat, self.known)
        width = len(self.ids)
        n = np.bincount(code, minlength=len(self.known))
        common = n >= max(2, COMMON * width)
        self.common = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), width))
        is_common = common[code]
        np.add.at(self.matrix, (self.common[code[is_common]], owner[is_common]), weight[is_common])
        order = np.argsort(code, kind="stable")
        self.query, self.weight = owner[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(n)])

    def sums(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of value * weight over common terms, rows by queries."""
        width, at = len(self.ids), self.common[code]
        some = at >= 0
        left = np.bincount(row[some] * len(self.matrix) + at[some], weights=value[some], minlength=n_rows * len(self.matrix))
        out = left.reshape(n_rows, len(self.matrix)) @ self.matrix
        row, code, value = row[~some], code[~some], value[~some]
        times = self.start[code + 1] - self.start[code]
        each = np.repeat(np.arange(len(code)), times)
        place = self.start[code][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        more = np.bincount(row[each] * width + self.query[place], weights=value[each] * self.weight[place], minlength=n_rows * width)
        return out + more.reshape(n_rows, width)


def _best(scores: np.ndarray, found: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each column, of equal ones the first rows; ``floor`` rises to each column's k-th."""
    scores = np.where(found, scores, -np.inf)
    if len(scores) >= k:
        np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k], out=floor)
    row, column = np.nonzero(found & (scores >= floor))
    order = np.lexsort((row, -scores[row, column], column))
    row, column = row[order], column[order]
    first = np.searchsorted(column, column)
    keep = np.arange(len(column)) - first < k
    return row[keep], column[keep]


def best_pairs(rows: DataFrame, asked: DataFrame, k: int, finish: Finish, decimals: int) -> DataFrame:
    """(query_id, key, score): of each query at least its k best rows, those with a sum over 0, scores to ``decimals``.

    rows (key, n, terms, values), terms of a row distinct; asked (query_id, m,
    terms, weights), one row a query. A sum is of value * weight over the terms
    that both have. Of equal scores the smaller keys come first, null before all.
    """
    files = _files(asked.select("query_id", F.col("m").cast("double").alias("m"), "terms", F.col("weights").cast("array<double>").alias("weights")), "asked-blocks", BLOCK_QUERIES)
    rows = rows.select("key", F.col("n").cast("double").alias("n"), "terms", F.col("values").cast("array<double>").alias("values"))
    scale = 10.0**decimals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = _one_by_one(files, _Block), {}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
            for file in files:
                asked = block(file)
                floor = floors.setdefault(file, np.full(len(asked.ids), -np.inf))
                at_once = max(1, min(CHUNK, CHUNK_VALUES // max(1, len(asked.matrix))))
                for start, length in _parts(batch.column(2), at_once, CHUNK_TERMS):
                    part = batch.slice(start, length)
                    row, code = _owners(part.column(2)), _codes(part.column(2).flatten(), asked.known)
                    value = part.column(3).flatten().to_numpy(zero_copy_only=False)
                    sums = asked.sums(row[code >= 0], code[code >= 0], value[code >= 0], len(part))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = finish(sums, part.column(1).to_numpy(zero_copy_only=False)[:, None], asked.m[None, :])
                    scores = np.floor(scores * scale + 0.5) / scale
                    i, j = _best(scores, sums > 0, floor, k)
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(scores[i, j])], names=["query_id", "key", "score"])

    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["key"]
    return map_arrow(rows, run, f"query_id {kinds[0]}, key {kinds[1]}, score double")
