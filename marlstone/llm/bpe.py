"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read once on the driver (it is a few megabytes whatever the
corpus) and sent to the executors as a broadcast value. Long texts are cut
before the pattern and the merges see them, at places that no match of the
pattern can span: before white space that follows a character that is not white
space. Each cut piece encodes to the ids that the whole text would give there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

#: Characters of a text from which it is cut at safe boundaries.
PIECE_CHARS = 1 << 16

#: White space of more characters than this is not given to the pattern.
RUN_CHARS = 4096
#: The characters of Unicode's White_Space, which are the pattern's ``\s``.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_boundary = re.compile(r"(?<=\S)(?=\s)")
_long_run = re.compile(f"[{WHITE}]{{{RUN_CHARS + 1},}}+")
_coders: dict[str, tuple] = {}


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _coder(ranks: bytes, pattern: str):
    """The encoding and the decimal form of each id, made once per worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _coders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        own = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _coders[key] = own, [str(i) for i in range(max(table.values()) + 1)]
    return _coders[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` into pieces of about ``size`` characters at safe boundaries.

    The place must have a non-space before it and a space after it for Python's
    ``\\s`` and for the pattern's; the two differ only in U+001C to U+001F and
    U+0085, before or after which no cut is made. A run without such a
    place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = None
        for m in _boundary.finditer(text, start + size):
            i = m.start()
            if text[i] not in "\x1c\x1d\x1e\x1f\x85" and text[i - 1] not in "\x1c\x1d\x1e\x1f\x85":
                cut = i
                break
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _encode_between(coder, text: str, size: int) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        ids.extend(coder.encode_ordinary(piece))
    return ids


def encode_text(coder, text: str, size: int = PIECE_CHARS) -> list[int]:
    """The ids of a text of any length, each match of the pattern merged separately."""
    if len(text) <= RUN_CHARS:
        return _encode_between(coder, text, size)
    ids: list[int] = []
    start = 0
    for run in _long_run.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids.extend(_encode_between(coder, text[start : run.start()], size))
        ids.extend(coder._encode_single_piece(text[run.start() : end]))
        start = end
    return ids + _encode_between(coder, text[start:], size)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, size: int = PIECE_CHARS, verify: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by a space), decoded_sha256 (of the decoded bytes), and
    with ``with_ids`` also token_ids, with ``verify`` also decoded_ok, whether the
    decoded bytes are those of the text. A null text counts as empty (no tokens);
    a null id stays null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("token_ids", pa.list_(pa.int32()))] if with_ids else []
    fields += [("decoded_ok", pa.bool_())] if verify else []
    kinds = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = _coder(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                counts, ids_hash, bytes_hash, lists, same = [], [], [], [], []
                for cell in some.column(1):
                    text = cell.as_py() or ""
                    ids = encode_text(coder, text, size)
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    bytes_hash.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
                    if verify:
                        same.append(bytes_hash[-1] == hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        lists.append(ids)
                columns = [some.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash)]
                columns += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
                columns += [pa.array(same, pa.bool_())] if verify else []
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded_ok boolean" * verify
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, out)


def decode_documents(tokens: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Decode id lists to raw bytes: (doc_id, bytes). A null list decodes to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, pattern))
    kinds = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = _coder(*shared.value)
        for batch in batches:
            data = [coder.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema=kinds)

    return map_arrow(tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, bytes binary")
