"""Dictionaries of many words, looked for in texts all at once.

A dictionary is a table (word, value, place). It is written to the shared folder
in files of a bounded number of words; a task builds one automaton for each file
and runs every text through it once, whatever the number of words. So the plan
does not grow with the dictionary, nothing is broadcast, and no pair of text and
word is tested. What is found comes as a column, next to the text.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping

import ahocorasick
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package
from ..staging import staged

#: Words of one automaton, and automata that a task keeps.
BLOCK_WORDS = 200_000
_KEPT = 4
FOUND = "array<struct<word:string,value:string,place:long,n:int,at:int>>"

_automata: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def read_shared(file: str, columns: list[str]):
    """A file of the shared folder, read by a task."""
    store, path = pafs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        return pq.read_table(source, columns=columns)


def _automaton(file: str) -> ahocorasick.Automaton:
    if file not in _automata:
        made = ahocorasick.Automaton()
        for word, value, place in zip(*(c.to_pylist() for c in read_shared(file, ["word", "value", "place"]).columns), strict=True):
            made.add_word(word, (word, value, place))
        made.make_automaton()
        _automata[file] = made
        while len(_automata) > _KEPT:
            _automata.popitem(last=False)
    _automata.move_to_end(file)
    return _automata[file]


def _search(text: str | None, automata: list[ahocorasick.Automaton]) -> list[tuple]:
    found: dict[str, list] = {}
    for automaton in automata:
        if text and len(automaton):
            for end, (word, value, place) in automaton.iter(text):
                if word in found:
                    found[word][3] += 1
                else:
                    found[word] = [word, value, place, 1, end - len(word) + 1]
    return sorted(map(tuple, found.values()), key=lambda x: (x[4], -len(x[0])))


def matcher(words: DataFrame, block: int = BLOCK_WORDS) -> Callable[[Column], Column]:
    """A function that finds the words of a dictionary (word, value, place) in a text column.

    It gives an array of struct(word, value, place, n, at), in the order of the
    text and the longer first: n occurrences, overlaps included, the first of
    them behind ``at`` characters. Of rows with one word the one of the smallest
    place counts, then of the smallest value. Empty and null words are left out;
    a null or empty text has none.
    """
    once = words.where("word is not null and word <> ''").groupBy("word").agg(F.min(F.struct(F.col("place").cast("long").alias("place"), F.col("value").cast("string").alias("value"))).alias("m"))
    table = staged(once.select("word", "m.value", "m.place"), "dictionary", maxRecordsPerFile=block)
    files = sorted(table.inputFiles())  # names only
    share_package(words.sparkSession)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if len(files) <= _KEPT:
                automata = [_automaton(f) for f in files]
                yield pd.Series([_search(t, automata) for t in texts])
                continue
            # One automaton after the other over the whole batch, so that each is built once a batch.
            parts = [[_search(t, [made]) for t in texts] for made in map(_automaton, files)]
            yield pd.Series([sorted((x for p in row for x in p), key=lambda x: (x[4], -len(x[0]))) for row in zip(*parts, strict=True)])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, FOUND)


def mapping_matcher(spark: SparkSession, names: Mapping[str, str]) -> Callable[[Column], Column]:
    """``matcher`` of a mapping from word to value; the place is the order of declaration."""
    rows = [(w, v, i) for i, (w, v) in enumerate(names.items())]
    return matcher(spark.createDataFrame(rows, "word string, value string, place long"))


def longest(found: Column) -> Column:
    """The value of the longest word; of equally long ones, the first in order of code points; null without any."""
    best = F.array_sort(found, lambda a, b: F.when(F.length(a["word"]) != F.length(b["word"]), F.length(b["word"]) - F.length(a["word"])).when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0))
    return F.try_element_at(best, F.lit(1))["value"]


def first_declared(found: Column) -> Column:
    """The value of the word that the dictionary names first; null without any."""
    return F.array_min(F.transform(found, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"))))["value"]


def all_values(found: Column) -> Column:
    """The distinct values, in the order in which the text mentions them."""
    return F.array_distinct(F.transform(found, lambda x: x["value"]))
