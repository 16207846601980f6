"""WARC archives compressed with Zstandard: one frame per record, dictionary first.

An archive begins with a skippable frame that holds the dictionary of its frames.
The reader loads it, finds the length of each frame from its block headers, decodes
one record per frame and checks it: version line, required fields, stated lengths,
end of record and digests.

Pages with equal payloads are stored once: the page with the largest id is a
``response``, the others are ``revisit`` records that name it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_columns
from tablewright.llm.common import is_small, short_batches, slices, stored
from tablewright.llm.files import read_all, write_new
from tablewright.session import scratch_path

# Fixed values of the formats.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
FRAME = (0xFD2FB528).to_bytes(4, "little")
VERSION = b"WARC/1.1"
READABLE = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Record types that are pages; the reader passes over all others.
PAGE_TYPES = ("response", "revisit")
#: Most bytes of a record whose frame does not state its size.
RECORD_BYTES = 1 << 30
#: Payload bytes after which a task closes an archive.
ARCHIVE_BYTES = 32 * 1024 * 1024
#: Size of a dictionary, and the most bytes of records that it is trained on.
DICTIONARY_BYTES = 32 * 1024
SAMPLE_BYTES = 1024 * 1024
_ID_URN = "urn:x-page:"

MANIFEST = "path string, records bigint, bytes bigint"


#: Field names this module uses, by their lower-case form: case does not matter in archives.
_NAMES = {
    name.lower(): name
    for name in (
        *REQUIRED, "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Profile", "WARC-Refers-To",
        "Content-Type",
    )
}


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<{_ID_URN}{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    if not record_id.startswith(f"<{_ID_URN}") or not record_id.endswith(">"):
        raise ArchiveError(f"unknown record id {record_id}")
    name = record_id[len(_ID_URN) + 1 : -1]
    return None if name == "none" else int(name)


def page_record(
    page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str
) -> bytes:
    """One record: the page's HTTP response, or a revisit with its HTTP header alone."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id)}
    fields["WARC-Date"] = date
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c for c in url if c not in "\r\n")
    fields["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    fields["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    if revisit:
        fields["WARC-Profile"] = REVISIT_PROFILE
        fields["WARC-Refers-To"] = _record_id(refers_to)
    fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """Dictionary frame and one frame per record.

    The dictionary is trained on records from the whole archive, up to
    ``SAMPLE_BYTES``; where they are too few for one, the archive has none.
    """
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = records[::step]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        trained = None
    out = []
    if trained is not None:
        held = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        out += [SKIPPABLE, len(held).to_bytes(4, "little"), held]
        packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    else:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    out += map(packer.compress, records)
    return b"".join(out)


def frame_length(data: memoryview) -> int:
    """Length of the Zstandard frame that ``data`` begins with, from its headers."""
    if bytes(data[:4]) != FRAME:
        raise ArchiveError("no frame where one should begin")
    try:
        at = zstandard.frame_header_size(data[:18])
    except zstandard.ZstdError as error:
        raise ArchiveError("damaged frame header") from error
    checksum = data[4] >> 2 & 1
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("archive ends inside a frame")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("damaged block")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ArchiveError("archive ends inside a frame")
    return at


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises ``ArchiveError`` unless it is whole and valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in READABLE:
        raise ArchiveError("record without version line or end of header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[_NAMES.get(name.lower(), name)] = value.strip()
    for name in REQUIRED:
        if name not in fields:
            raise ArchiveError(f"{name} is missing")
    stated = fields["Content-Length"]
    if not stated.isdigit() or int(stated) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("stated and actual length differ")
    block = rest[:-4]
    if fields.get("WARC-Block-Digest", "") not in ("", f"sha1:{sha1_base32(block)}"):
        raise ArchiveError("block digest differs")
    return fields, block


def unpack_frame(frame: memoryview, unpacker: zstandard.ZstdDecompressor) -> bytes:
    """Content of one frame, also where a streaming writer has left its size out."""
    if zstandard.frame_content_size(frame) >= 0:
        return unpacker.decompress(frame)
    out, size = [], 0
    with unpacker.stream_reader(frame) as reader:
        while part := reader.read(1 << 20):
            size += len(part)
            if size > RECORD_BYTES:
                raise ArchiveError(f"record of over {RECORD_BYTES} bytes")
            out.append(part)
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of an archive."""
    view = memoryview(data)
    at = 0
    known = None
    if data[:4] == SKIPPABLE:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise ArchiveError("archive ends inside the dictionary")
        held = data[8:at]
        if held[:4] == FRAME:
            held = zstandard.ZstdDecompressor().decompress(held)
        known = zstandard.ZstdCompressionDict(held)
    unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        length = frame_length(view[at:])
        try:
            record = unpack_frame(view[at : at + length], unpacker)
        except zstandard.ZstdError as error:
            raise ArchiveError(f"damaged frame: {error}") from error
        yield parse_record(record)
        at += length


def page_of(fields: dict[str, str], block: bytes) -> dict[str, object]:
    """Page of a response or revisit record, its payload checked against the digest."""
    kind = fields["WARC-Type"]
    if kind not in PAGE_TYPES:
        raise ArchiveError(f"unexpected record type {kind}")
    head, found, payload = block.partition(b"\r\n\r\n")
    lengths = [
        int(line.partition(b":")[2])
        for line in head.split(b"\r\n")[1:]
        if line.lower().startswith(b"content-length:")
    ]
    if not found or not head.startswith(b"HTTP/") or len(lengths) != 1:
        raise ArchiveError("damaged HTTP header")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != lengths[0] or sha1_base32(payload) != digest):
        raise ArchiveError("payload differs from its length or digest")
    if kind == "revisit" and (payload or fields.get("WARC-Profile") != REVISIT_PROFILE):
        raise ArchiveError("damaged revisit record")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": lengths[0],
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def write_archives(
    df: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row; returns the manifest (``path, records, bytes``).

    Of rows with equal payloads of at least ``revisit_from_bytes`` bytes, those with
    the largest id are responses and the others revisit them.  Null payloads are
    empty; a null url leaves its field out; a null id ranks below all others.
    Repeated rows get a record each.  An empty table gives an empty manifest.
    """
    require_columns(df, [id_col, url_col, payload_col])
    short_batches(df.sparkSession)
    folder = folder or scratch_path(df.sparkSession, "warc")
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    pages = df.select(
        col(id_col).cast("bigint").alias("id"),
        col(url_col).cast("string").alias("url"),
        payload.alias("text"),
        F.sha2(payload.cast("binary"), 256).alias("content"),
    )
    narrow = stored(
        pages.where(F.octet_length("text") >= revisit_from_bytes).select("id", "content"), "warc-contents"
    )
    groups = stored(
        narrow.groupBy("content").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"),
        "warc-groups",
    )
    revisits = stored(
        narrow.join(groups.select("content", "refers_to"), "content")
        .where(~F.col("id").eqNullSafe(F.col("refers_to")))
        .select(F.col("id").alias("rid"), F.col("content").alias("rcontent"), "refers_to")
        .distinct(),
        "warc-revisits",
    )
    told = F.broadcast(revisits) if is_small(revisits) else revisits
    match = F.col("id").eqNullSafe(F.col("rid")) & (F.col("content") == F.col("rcontent"))
    planned = pages.join(told, match, "left").select(
        "id", "url", "text", "refers_to", F.col("rcontent").isNotNull().alias("revisit")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            data = build_archive(held)
            row = [write_new(folder, ".warc.zst", data)], [len(held)], [len(data)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64()))],
                ["path", "records", "bytes"],
            )

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "text", "revisit", "refers_to")]
            for page_id, url, text, revisit, refers_to in zip(*columns):
                held.append(page_record(page_id, url, text.encode(), revisit, refers_to, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    size = 0
        if held:
            yield archive()

    planned.mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


_SCHEMA = pa.schema(
    {
        "page_id": pa.int64(),
        "url": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "payload": pa.binary(),
    }
)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives in ``path``; other records are passed over.

    Columns: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest``
    and, with ``payloads``, ``payload`` (null for revisits).  A damaged archive
    raises ``ArchiveError``.
    """
    schema = _SCHEMA if payloads else _SCHEMA.remove(6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                for fields, block in read_archive(read_all(path)):
                    if fields["WARC-Type"] not in PAGE_TYPES:
                        continue
                    rows.append(page_of(fields, block))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(manifest.count(), 10_000))
    spread = manifest.select("path").repartition(tasks, "path")
    types = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return spread.mapInArrow(work, ", ".join(f"{f.name} {types[f.type]}" for f in schema))
