"""Segmentation of Chinese text by a dictionary with frequencies.

A run of Chinese characters is a graph: an edge for every dictionary word that
stands in it, and one for every single character. The most probable path, by the
product of the words' shares of all frequencies, is found from the end backwards
in time linear in the run. Dictionary and frequencies are a table; nothing is
trained. Letters and numbers are tokens as in the plain tokeniser.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import share_package
from ..staging import staged
from .matching import read_shared

#: Words that a dictionary may have, as every worker holds it.
MOST_WORDS = 2_000_000
_TOKEN = re.compile(r"[一-鿿]+|[a-z]+|\d+(?:\.\d+)?%?")


class Segmenter:
    """Words with frequencies. Words without a positive one count as seen once."""

    def __init__(self, words: Mapping[str, int]):
        self.words = {w: max(1, n or 1) for w, n in words.items() if w}
        self.total = math.log(sum(self.words.values()) or 1)
        self.prefixes = {w[:i] for w in self.words for i in range(1, len(w))}

    def _weight(self, word: str) -> float:
        return math.log(self.words.get(word, 1)) - self.total

    def cut(self, run: str) -> list[str]:
        """The most probable words of a run; of equal paths the one whose first word is longest."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            found = (self._weight(run[i]) + best[i + 1][0], i + 1)
            end = i + 1
            # Longer words are tried as long as some word goes on like this.
            while end < n and run[i:end] in self.prefixes:
                end += 1
                if run[i:end] in self.words:
                    found = max(found, (self._weight(run[i:end]) + best[end][0], end))
            best[i] = found
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def tokens(self, text: str | None, stop: frozenset[str] = frozenset(), least: int = 1) -> list[str]:
        """Lower-cased words, letters and numbers of at least ``least`` characters, without stop words, in order."""
        out: list[str] = []
        for found in _TOKEN.findall((text or "").lower()):
            out += self.cut(found) if "一" <= found[0] <= "鿿" else [found]
        return [w for w in out if len(w) >= least and w not in stop]


@lru_cache(maxsize=2)
def _loaded(files: tuple[str, ...]) -> Segmenter:
    words: dict[str, int] = {}
    for file in files:
        table = read_shared(file, ["word", "freq"])
        words.update(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    return Segmenter(words)


def segmenter(dictionary: DataFrame, stop: list[str] | None = None, least: int = 1) -> Callable[[Column], Column]:
    """A tokeniser by a dictionary (word, freq): a function from a text column to an array of tokens.

    Rows of one word are summed. The dictionary is written to the shared folder
    and read once by every worker; one of more than MOST_WORDS is refused. Index,
    queries and guard that are to agree must be given the same function.
    """
    rows = dictionary.where("word is not null and word <> ''").groupBy("word").agg(F.sum(F.coalesce(F.col("freq"), F.lit(1)).cast("long")).alias("freq"))
    table = staged(rows, "segmentation-words")
    if table.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
    share_package(dictionary.sparkSession)
    files, without = tuple(sorted(table.inputFiles())), frozenset(stop or ())

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            words = _loaded(files)
            yield pd.Series([words.tokens(t, without, least) for t in texts])

    cut.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(cut, "array<string>")
