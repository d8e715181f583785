"""Phrase collocations, counted by suffix-sigma.

Every position of a text gives one suffix, cut after ``max_n`` words and at the
end of its piece. Suffixes are shuffled by language and first word and sorted in
reverse lexicographic order; then one pass with a stack of open prefixes counts
all phrases of up to ``max_n`` words at once (Berberich and Bedathur, "Computing
n-gram statistics in MapReduce", 2013). The frequencies of a phrase's parts are
joined to it afterwards.

A first survey of all words finds the languages' sizes and the frequent first
words. Equal suffixes of a task are combined before the shuffle, and the suffixes
of a frequent first word are spread over tasks in proportion to its share by the
words that follow; what such tasks count are parts of sums, which are added up.
So no first word or pair, however frequent, makes a large task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import map_arrow
from .scratch import discard, lookup, staged
from .words import cut_words

#: Positions of texts that a task combines at once, and bytes of text that it splits at once.
BLOCK = 1 << 21
PART_BYTES = 1 << 20
#: Combined rows that a task writes out as strings at once.
_SLICE = 1 << 17
#: First words that are spread over tasks are more than one in so many words, or than a task's share if that is more.
FREQUENT = 20_000
#: Parts of a language in which phrases are ranked before the parts are merged.
_SALTS = 64
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_END = b"."  # a separator is no part of a word, so it marks the end of a piece


def _tokens(text: bytes, carry: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of tokens with the number of those that the run owns; _END stands between pieces."""
    spaced = text.translate(_FOLD).replace(_END, b" . ")
    for own, carried in cut_words(spaced, PART_BYTES, carry):
        tokens = own.split()
        yield len(tokens), tokens + carried.split()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.encode(F.col(text_col), "UTF-8").alias("text")).where("text is not null")


class _Block:
    """Positions of one task: the ids of their words, the language first; id 0 ends a piece."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.clear()

    def clear(self) -> None:
        self.names: list[bytes] = [b""]
        self.ids: dict[bytes, int] = {_END: 0}
        self.langs: dict[str, int] = {}
        self.columns: list[list[np.ndarray]] = [[] for _ in range(self.max_n + 1)]
        self.held = 0

    def _number(self, word: bytes) -> int:
        self.ids[word] = found = len(self.names)
        self.names.append(word)
        return found

    def add(self, lang: str, own: int, tokens: list[bytes]) -> None:
        if lang not in self.langs:
            self.langs[lang] = len(self.langs)
        ids = self.ids
        for word in set(tokens).difference(ids):
            self._number(word)
        found = np.zeros(len(tokens) + self.max_n, np.int32)
        found[: len(tokens)] = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
        at = np.flatnonzero(found[:own])
        self.columns[0].append(np.full(len(at), self.langs[lang], np.int32))
        alive = np.ones(len(at), bool)
        for k in range(self.max_n):
            step = found[at + k]
            alive &= step != 0
            self.columns[k + 1].append(np.where(alive, step, 0).astype(np.int32))
        self.held += len(at)

    def _descending(self) -> np.ndarray:
        """The place of each id among the words in descending byte order; the end of a piece comes last."""
        places = np.empty(len(self.names), np.int32)
        places[sorted(range(1, len(self.names)), key=self.names.__getitem__, reverse=True)] = np.arange(len(self.names) - 1)
        places[0] = len(self.names) - 1
        return places

    def combined(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct rows (language, words), with the words descending, and how often each occurs."""
        columns = [np.concatenate(c) if c else np.zeros(0, np.int32) for c in self.columns]
        if not len(columns[0]):
            return columns, np.zeros(0, np.int64)
        places = self._descending()
        order = np.lexsort([*(places[c] for c in columns[:0:-1]), columns[0]])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        return [c[starts] for c in columns], np.diff(np.append(starts, len(order))).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[_Block]:
    """Blocks of about BLOCK positions; the block is empty again when the next is asked for."""
    block = _Block(max_n)
    for batch in batches:
        for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for own, tokens in _tokens(cell.as_py(), max_n - 1):
                block.add(lang, own, tokens)
                if block.held >= BLOCK:
                    yield block
                    block.clear()
    if block.held:
        yield block


def survey(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", frequent: int = FREQUENT) -> DataFrame:
    """(lang, word, n): how many words each language has (word null), and its frequent first words.

    A block names a word if it is more than one in ``frequent`` of its words. A
    word that frequent in all text is named by some block; n then counts the
    blocks that name it. Languages' sizes are exact.
    """
    kinds = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            (langs, words), counts = block.combined()
            names = list(block.langs)
            totals = np.bincount(langs, weights=counts, minlength=len(names)).astype(np.int64)
            often = counts * frequent > block.held
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names + [names[k] for k in langs[often]], pa.string()),
                    pa.array([None] * len(names) + [block.names[k].decode() for k in words[often]], pa.string()),
                    pa.array(np.concatenate([totals, counts[often]])),
                ],
                schema=kinds,
            )

    found = map_arrow(_rows(docs, text_col, lang_col), run, "lang string, word string, n long")
    return staged(found.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-survey")


def _spread(found: DataFrame, tasks: int, frequent: int) -> dict[tuple[str, bytes], int]:
    """Over how many tasks the suffixes of each frequent first word are spread; at most ``frequent`` words."""
    total = found.where("word is null").agg(F.sum("n")).first()[0] or 0
    share = max(1, total // min(frequent, max(2, 2 * tasks)))
    rows = found.where(F.col("word").isNotNull() & (F.col("n") > share)).orderBy(F.desc("n")).limit(frequent).collect()
    return {(lang, word.encode()): 1 + 2 * n // share for lang, word, n in rows}


def _suffixes(docs: DataFrame, max_n: int, text_col: str, lang_col: str, spread: dict[tuple[str, bytes], int]) -> DataFrame:
    """(part, key, n): combined suffixes; ``part`` says where they are counted, below zero for parts of a sum.

    ``key`` is the language and the words, each ended by a line break, which
    neither has inside: so keys with the same first words stand together in
    byte order. A block's keys come in the order in which they are counted, so
    the sort behind the shuffle only merges.
    """
    kinds = pa.schema([("part", pa.int32()), ("key", pa.string()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(spread)  # FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, max_n):
            (langs, *words), counts = block.combined()
            names = [x.replace("%", "%25").replace("\n", "%0A").encode() for x in block.langs]
            hashes = np.fromiter(map(crc32, block.names), np.int64, len(block.names))
            part = (hashes[words[0]] * 31 + np.fromiter(map(crc32, names), np.int64, len(names))[langs]) % 0x7FFFFFFF
            over = np.ones(len(counts), np.int64)
            wide = len(block.names)
            here = sorted((block.langs[lang] * wide + block.ids[word], tasks) for (lang, word), tasks in shared.value.items() if lang in block.langs and word in block.ids)
            if here:
                codes, tasks = np.array(here, np.int64).T
                code = langs.astype(np.int64) * wide + words[0]
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                over = np.where(codes[at] == code, tasks[at], 1)
            rest = np.zeros(len(counts), np.int64)
            for column in words[1:]:
                rest = (rest * 1_000_003 + hashes[column]) % 0x7FFFFFFF
            spread_to = (part + rest % over * 7919) % 0x7FFFFFFF
            ended = pa.array([b""] + [x + b"\n" for x in block.names[1:]], pa.binary())
            heads = pa.array([x + b"\n" for x in names], pa.binary())
            place = np.where(over > 1, -1 - spread_to, part).astype(np.int32)
            for begin in range(0, len(counts), _SLICE):
                cut = slice(begin, begin + _SLICE)
                key = pc.binary_join_element_wise(heads.take(pa.array(langs[cut])), *(ended.take(pa.array(c[cut])) for c in words), b"")
                yield pa.RecordBatch.from_arrays([pa.array(place[cut]), key.cast(pa.string()), pa.array(counts[cut])], schema=kinds)

    return map_arrow(_rows(docs, text_col, lang_col), run, "part int, key string, n long")


class _Stack:
    """The open prefixes of the sorted suffixes, one for each number of words, with their counts so far."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.open: list[tuple[str, int, bool] | None] = [None] * max_n
        self.done: list[tuple[pa.Array, np.ndarray, int]] = []

    def _closed(self, level: int, prefixes: pa.Array, sums: np.ndarray, partial: np.ndarray) -> None:
        often = np.flatnonzero((sums >= self.least) | (partial & (level < self.max_n - 1)))
        if len(often):
            self.done.append((prefixes.take(pa.array(often)), sums[often], level + 1))

    def close(self) -> None:
        for level, top in enumerate(self.open):
            if top:
                self._closed(level, pa.array([top[0]]), np.array([top[1]]), np.array([top[2]]))
            self.open[level] = None

    def add(self, keys: pa.Array, counts: np.ndarray, partial: np.ndarray) -> None:
        """Push the next suffixes in order; prefixes that a suffix does not continue are popped."""
        split = pc.split_pattern(keys, "\n")
        ends = split.offsets.to_numpy()
        begin, size = ends[:-1], np.diff(ends) - 1  # what follows the last line break is empty
        values = split.values
        joined = values.take(pa.array(begin))
        changed = np.ones(len(keys), bool)
        changed[1:] = pc.not_equal(joined[1:], joined[:-1]).to_numpy(zero_copy_only=False)
        for level in range(self.max_n):
            there = size > level + 1
            word = values.take(pa.array(np.where(there, begin + level + 1, ends[1:] - 1)))
            changed[1:] |= pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            joined = pc.binary_join_element_wise(joined, word, "\n")
            starts = np.flatnonzero(changed)
            sums = np.add.reduceat(counts, starts)
            real = there[starts]
            starts, sums = starts[real], sums[real]
            if not len(starts):
                continue
            prefixes, parts = joined.take(pa.array(starts)), partial[starts]
            top = self.open[level]
            if top and top[0] == prefixes[0].as_py():
                sums[0] += top[1]
            elif top:
                self._closed(level, pa.array([top[0]]), np.array([top[1]]), np.array([top[2]]))
            self._closed(level, prefixes[:-1], sums[:-1], parts[:-1])
            self.open[level] = (prefixes[-1].as_py(), int(sums[-1]), bool(parts[-1]))

    def popped(self) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        yield from self.done
        self.done = []


def phrase_counts(docs: DataFrame, max_n: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", words: DataFrame | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(lang, phrase, size, f): phrases of 1 to ``max_n`` words that occur ``min_count`` times or more, and how often.

    A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` end a piece, words are
    ``[^\\x20\\x09]+``, phrases do not reach over pieces and count with all
    overlaps. A null language is ``und``; a null or empty text has no words; an
    empty table gives an empty result. ``words`` is the result of ``survey``.
    """
    if max_n < 1:
        raise ValueError("max_n is 1 or more")
    words = survey(docs, text_col, lang_col, frequent) if words is None else words
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _suffixes(docs, max_n, text_col, lang_col, _spread(words, tasks, frequent))
    rows = rows.repartition("part").sortWithinPartitions(F.desc("key"))
    kinds = pa.schema([("key", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(max_n, min_count)
        for batch in batches:
            if batch.num_rows:
                stack.add(batch.column(1), batch.column(2).to_numpy(), batch.column(0).to_numpy() < 0)
            for prefixes, sums, size in stack.popped():
                yield pa.RecordBatch.from_arrays([prefixes, pa.array(np.full(len(sums), size, np.int32)), pa.array(sums)], schema=kinds)
        stack.close()
        for prefixes, sums, size in stack.popped():
            yield pa.RecordBatch.from_arrays([prefixes, pa.array(np.full(len(sums), size, np.int32)), pa.array(sums)], schema=kinds)

    found = map_arrow(rows, run, "key string, size int, n long").groupBy("key", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    escaped = F.substring_index("key", "\n", 1)
    lang = F.replace(F.replace(escaped, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    phrase = F.replace(F.substring(F.col("key"), F.length(escaped) + 2, F.length("key")), F.lit("\n"), F.lit(" "))
    return found.select(lang.alias("lang"), phrase.alias("phrase"), "size", "f")


def _scored(counts: DataFrame, max_n: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase of two words or more, by its weakest cut."""
    parts = lookup(counts.select("lang", "phrase", "f"))
    left = parts.select(F.col("lang").alias("llang"), F.col("phrase").alias("lphrase"), F.col("f").alias("l"))
    right = parts.select(F.col("lang").alias("rlang"), F.col("phrase").alias("rphrase"), F.col("f").alias("r"))
    cuts = counts.where("size > 1").withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(left, (F.col("lang") == F.col("llang")) & (F.col("first") == F.col("lphrase")))
    cuts = cuts.join(right, (F.col("lang") == F.col("rlang")) & (F.col("rest") == F.col("rphrase")))
    # Exact for frequencies below 10**16; no part is rarer than the phrase, so the score is at most a million.
    score = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def _longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases that stand inside longer ones, and the most frequent of these."""
    inner = counts.where("size > 2").withColumn("words", F.split("phrase", " ")).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    return inner.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", frequent: int = FREQUENT) -> DataFrame:
    """The ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of 2 to ``max_n`` words that occur ``a >= min_count``
    times. Cut in two, a phrase has the score ``floor(1000000 * a * a / (l *
    r))`` with the frequencies of its parts; its lowest cut counts, of equal ones
    the first. Candidates inside a longer one that has ``inside`` per cent of
    their frequency go, whether that one goes or not. Ranked by score, then a,
    descending, then by the phrase's bytes. n is the number of words of the
    language. Nulls, empty texts and tables as in ``phrase_counts``; repeated
    rows count again; other columns play no part.
    """
    words = survey(docs, text_col, lang_col, frequent)
    counts = staged(phrase_counts(docs, max_n, min_count, text_col, lang_col, words, frequent), "phrase-counts")
    found = _scored(counts, max_n).join(_longer(counts), ["lang", "phrase"], "left")
    found = found.where(F.coalesce(F.col("most") * 100 < F.col("a") * inside, F.lit(True)))
    found = staged(found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))), "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that the last ranking sees few rows of each.
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = lookup(words.where("word is null").select("lang", "n"))
    out = staged(found.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts, words)
    return out
