"""Word arrays and rolling hashes for tasks that work on whole batches of texts.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` with no
argument splits UTF-8 at exactly those characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are turned into arrays at once; a longer text is its own chunk.
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_VOCABULARY = 1 << 18


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def chunks(batch: pa.RecordBatch, text_column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows with about CHUNK_BYTES of text: (first row, texts; null is empty)."""
    start, held, texts = 0, 0, []
    for i, cell in enumerate(batch.column(text_column)):
        text = cell.as_py() or b""
        if texts and held + len(text) > CHUNK_BYTES:
            yield start, texts
            start, held, texts = i, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield start, texts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any runs of a word-hash array, from prefix sums modulo 2**64."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if len(Rolling._up) < n:
            size = max(n, 2 * len(Rolling._up))
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(words * Rolling._up[: n - 1], out=self._sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for each pair."""
        return mixed((self._sums[ends] - self._sums[starts]) * Rolling._down[starts])


def cut_words(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, bytes]]:
    """Cut a text whose words stand between spaces into parts of about ``size`` bytes: (own, carried).

    A part ends before a space, so no word is cut; a word longer than ``size``
    makes a longer part. ``carried`` are the ``carry`` words that follow a part.
    Runs of words are owned by the part in which they start, so each run of up
    to ``carry + 1`` words is found in exactly one part.
    """
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + size)
        end = len(text) if end < 0 else end
        after = (m.group() for m in _WORD.finditer(text, end))
        yield text[begin:end], b" ".join(word for _, word in zip(range(carry), after))
        begin = end


_WORD = re.compile(rb"[^ ]+")
