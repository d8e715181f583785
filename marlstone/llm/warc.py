"""WARC archives: one gzip member per record, written and read in sequence.

The writer turns each partition into archives of bounded size. Records whose
payloads are equal are stored once; the others become revisit records. Archives
are written under a temporary name and moved into place, so a task that is run
again replaces its own files and leaves no half-written ones.

The reader takes one archive at a time and decompresses it incrementally: it
holds the header of the current record and a block of the stream, never the
archive. Blocks are framed by Content-Length, and block and payload digests are
verified as the bytes pass.

Files are opened with ``pyarrow.fs`` by their full URI, so the folder may be on
any store that pyarrow knows; it must be one that all executors share.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .scratch import new_path, staged

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Bytes read from an archive at a time.
BLOCK = 1 << 20
#: Fixed values of the WARC 1.1 format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

_control = re.compile(r"[\x00-\x20\x7f]")


def _header(first: bytes, fields: list[tuple[str, str]]) -> bytes:
    return first + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _urn(page: int | None) -> str:
    return "<urn:page:null>" if page is None else f"<urn:page:{page}>"


def _from_urn(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def encode_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it."""
    http = _header(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", date)]
    if url is not None:
        # White space and control characters would break the header apart.
        fields.append(("WARC-Target-URI", _control.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_header(_VERSION, fields) + block + _END) + packer.flush()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, owner, revisit): which rows store their payload.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    smallest page_id stores it. Rows that repeat that id all store it. A null id
    is never smallest; if all ids are null, all rows store their payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    owners = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("c"))
    owners = staged(owners.where("c > 1 and owner is not null").select("digest", "owner"), "payload-owners")
    joined = rows.join(owners, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", "owner", (F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))).alias("revisit"))


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write a record for each row to archives in ``folder``; the manifest (path, records, bytes).

    Columns are named as for ``plan_records``. Null html is an empty payload and
    a null url leaves out the target. An empty table writes no archives.
    """
    planned = plan_records(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        made, sink, name = [], None, ""

        def close() -> None:
            sink.close()
            store.move(name + f".{task.taskAttemptId()}.tmp", name)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page, url, payload, digest, owner, revisit = (x.as_py() for x in row)
                if sink is None:
                    name = f"{root}/part-{task.partitionId():06d}-{len(made):04d}.warc.gz"
                    sink = store.open_output_stream(name + f".{task.taskAttemptId()}.tmp", compression=None)
                    made.append([name, 0, 0])
                data = encode_record(page, url, payload, digest, owner if revisit else None, revisit, date)
                sink.write(data)
                made[-1][1] += 1
                made[-1][2] += len(data)
                if made[-1][2] >= limit:
                    close()
                    sink = None
        if sink is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], schema=_MANIFEST)

    return staged(map_arrow(planned, run, "path string, records long, bytes long"), "warc-manifest")


class _Member:
    """The uncompressed bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.rest, self.done = stream, b"", False

    def open(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.rest:
            self.rest = self.stream.read(BLOCK)
        self.unpacker, self.ahead = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bytes:
        """Some further bytes of this member; none at its end."""
        while not self.unpacker.eof:
            if not self.rest and not self.unpacker.unconsumed_tail:
                self.rest = self.stream.read(BLOCK)
                if not self.rest:
                    raise ValueError("the archive ends within a gzip member")
            data = self.unpacker.decompress(self.unpacker.unconsumed_tail or self.rest, BLOCK)
            self.rest = b""
            if self.unpacker.eof:
                self.rest = self.unpacker.unused_data
            if data:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        while (at := self.ahead.find(mark)) < 0:
            data = self.more()
            if not data:
                raise ValueError("a record has no complete header")
            self.ahead += data
        out, self.ahead = self.ahead[: at + len(mark)], self.ahead[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in parts."""
        while n:
            part = self.ahead or self.more()
            if not part:
                raise ValueError("a block is shorter than its Content-Length")
            yield part[:n]
            self.ahead = part[n:]
            n -= min(n, len(part))

    def close(self) -> None:
        """Check that only the record's end mark is left."""
        tail = self.ahead
        while data := self.more():
            tail += data
            if len(tail) > len(_END):
                break
        if tail != _END:
            raise ValueError("a block is longer than its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _declared(value: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest, which is in hex or base32; no bytes if it is of neither form, null for an unknown algorithm."""
    name, _, text = value.partition(":")
    if name.lower() not in ("sha256", "sha1", "md5", "sha512"):
        return None
    size = hashlib.new(name.lower()).digest_size
    for decode in (bytes.fromhex, lambda x: base64.b32decode(x.upper() + "=" * (-len(x) % 8))):
        try:
            if len(found := decode(text)) == size:
                return name.lower(), found
        except (ValueError, binascii.Error):
            continue
    return name.lower(), b""


def iterate_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order.

    Each has headers, type, payload_bytes, payload_digest (hex SHA-256),
    digest_ok, and with ``with_payload`` the payload. Declared digests may be
    SHA-256, SHA-1, SHA-512 or MD5, in hex or base32, and anything else under these
    names is wrong; other algorithms are not verified, and digest_ok is null if
    nothing could be. The length of a revisit's payload comes
    from the HTTP header that it keeps; its digest is the declared one, in hex.
    Wrong framing raises ValueError; a wrong digest is reported in digest_ok.
    """
    member = _Member(stream)
    while member.open():
        head = member.until(_END)
        if not head.startswith(b"WARC/1."):
            raise ValueError("a gzip member is not a WARC record")
        fields = _fields(head)
        kind, length = fields.get("warc-type", ""), int(fields["content-length"])
        declared, of_block = (_declared(fields.get(f"warc-{x}-digest", "")) for x in ("payload", "block"))
        payload = hashlib.sha256()
        same, whole = (hashlib.new(x[0]) if x else None for x in (declared, of_block))
        http: dict[str, str] | None = None if "application/http" in fields.get("content-type", "") else {}
        start, size, kept = b"", 0, []
        for part in member.take(length):
            if whole:
                whole.update(part)
            if http is None:
                start += part
                at = start.find(_END)
                if at < 0:
                    continue
                http, part = _fields(start[: at + len(_END)]), start[at + len(_END) :]
            payload.update(part)
            if same:
                same.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        member.close()
        checks = [whole.digest() == of_block[1]] if whole else []
        if kind == "revisit":
            size, digest = int((http or {}).get("content-length", 0)), (declared[1].hex() or None) if declared else None
        else:
            digest = payload.hexdigest()
            checks += [same.digest() == declared[1]] if same else []
        good = all(checks) if checks else None
        yield {"headers": fields, "type": kind, "payload_bytes": size, "payload_digest": digest, "digest_ok": good, "payload": b"".join(kept) if with_payload else None}


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False, with_ids: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` names in column path.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    digest_ok, with ``with_ids`` also record_id and refers_to_id as they stand in
    the archive (page_id and refers_to are null for records that this writer has
    not made), and with ``with_payload`` the payload. An archive is the unit of
    work: it can only be read in sequence, and its size is bounded.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("digest_ok", pa.bool_())]
    fields += [("record_id", pa.string()), ("refers_to_id", pa.string())] if with_ids else []
    kinds = pa.schema(fields + ([("payload", pa.binary())] if with_payload else []))
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest_ok boolean" + ", record_id string, refers_to_id string" * with_ids + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in iterate_records(stream, with_payload):
                        if r["type"] not in ("response", "revisit"):
                            continue
                        h = r["headers"]
                        row = [_from_urn(h.get("warc-record-id")), r["payload_bytes"], r["payload_digest"], r["type"], _from_urn(h.get("warc-refers-to")), h.get("warc-target-uri"), r["digest_ok"]]
                        row += [h.get("warc-record-id"), h.get("warc-refers-to")] if with_ids else []
                        rows.append(row + ([r["payload"]] if with_payload else []))
                        held += len(r["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("path").repartition(parts), run, out)


def archive_and_read(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_path(spark, "warc")
    return read_warc(write_warc(pages, folder, **columns), folder)
