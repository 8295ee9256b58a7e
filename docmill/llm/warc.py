"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records,
and a last skippable frame with the seek table of the public seekable format
(compressed and decompressed size of each frame, frame count, descriptor, magic
number). An index maps each record to its bundle, frame and offset in the frame,
so that one record costs one frame.

Bundles are rows of a table (``bundle_id, archive, entries``): Spark commits each
task's bundles as a whole, and a task run again leaves no half-written file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Equal payloads from this size on are written once.
MIN_REVISIT_BYTES = 1000
#: Bytes of records in a frame, and of frames in a bundle, before the next is begun.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle_id string, archive binary, entries array<struct<record_id:long,frame:int,offset:int>>"
RECORDS = "record_id long, record_type string, uri string, digest string, refers_to long, payload binary"
COLUMNS = ["record_id", "row", "uri", "payload", "digest", "refers_to", "refers_row"]
#: What a payload is the body of.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer frame for ``(compressed, decompressed)`` sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed, decompressed)`` of each frame; ValueError if the footer isn't one."""
    if len(archive) < 17 or struct.unpack_from("<I", archive, len(archive) - 4)[0] != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    n, descriptor = struct.unpack_from("<IB", archive, len(archive) - 9)
    width = 12 if descriptor & 0x80 else 8
    at, out = len(archive) - 9 - n * width, []
    start = 0
    for k in range(n):
        c, d = struct.unpack_from("<II", archive, at + k * width)
        out.append((start, c, d))
        start += c
    if start + 8 != at:
        raise ValueError("the seek table doesn't fit the bundle")
    return out


def _urn(record_id: int | None, row: int) -> str:
    """The name of a record: its id, which may be null or there twice, and its row, which may not."""
    return f"<urn:docmill:record:{'' if record_id is None else record_id}:{row}>"


def record_bytes(record_id: int | None, row: int, uri: str, payload: bytes, digest: str, refers_to: int | None, refers_row: int | None, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_row is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id, row)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if uri:
        head.append("WARC-Target-URI: " + " ".join(uri.split()))
    block = HTTP_HEAD % len(payload) + payload
    if refers_row is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, refers_row)}"]
        block = b""
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> dict:
    """The record that begins at ``at`` of a decompressed frame."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(h["content-length"])]
    number = lambda urn: int(v) if (v := urn.rsplit(":", 2)[1]) else None
    return {
        "record_id": number(h["warc-record-id"]),
        "record_type": h["warc-type"],
        "uri": h.get("warc-target-uri"),
        "digest": h["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number(h["warc-refers-to"]) if "warc-refers-to" in h else None,
        "payload": block.partition(b"\r\n\r\n")[2],
    }


class Bundle:
    """Gathers records to one bundle."""

    def __init__(self, level: int) -> None:
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.size = self.total = 0
        self.ids = hashlib.sha1()

    def add(self, record_id: int, record: bytes) -> None:
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.close_frame()
        self.entries.append({"record_id": record_id, "frame": len(self.frames), "offset": self.size})
        self.ids.update(b"%s," % str(record_id).encode())
        self.open.append(record)
        self.size += len(record)

    def close_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.frames.append((len(packed), self.size))
            self.parts.append(packed)
            self.total += len(packed)
            self.open, self.size = [], 0

    def row(self) -> dict:
        self.close_frame()
        return {"bundle_id": self.ids.hexdigest(), "archive": b"".join(self.parts) + seek_table(self.frames), "entries": self.entries}


def bundles(records: DataFrame, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Bundles (schema ``BUNDLES``) of ``records`` (record_id, row, uri, payload, digest, refers_to, refers_row), some for each partition."""
    small_batches(records.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(records.sparkSession.createDataFrame([], BUNDLES).schema)

    def write(batches) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(level)
        for batch in batches:
            for rid, row, uri, payload, digest, refers, refers_row in zip(*(batch.column(n).to_pylist() for n in COLUMNS)):
                bundle.add(rid, record_bytes(rid, row, uri or "", payload or b"", digest, refers, refers_row, date))
                if bundle.total >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist([bundle.row()], schema=arrow)
                    bundle = Bundle(level)
        if bundle.entries:
            yield pa.RecordBatch.from_pylist([bundle.row()], schema=arrow)

    return records.select(*COLUMNS).mapInArrow(write, BUNDLES)


def read_record(archive: bytes, frame: int, offset: int) -> dict:
    """One record of a bundle, by its frame and the offset in it; reads that frame alone."""
    start, packed, size = read_seek_table(archive)[frame]
    return parse_record(zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=size), offset)


def read_bundles(packed: DataFrame) -> DataFrame:
    """All records (schema ``RECORDS``) of a table of bundles, found through seek table and index.

    A response whose payload doesn't have its digest raises. Bundles come a few in a
    batch, as :func:`small_batches` bounds its bytes.
    """
    small_batches(packed.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(packed.sparkSession.createDataFrame([], RECORDS).schema)

    def read(batches) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column("archive")[k].as_py()
                table_ = read_seek_table(archive)
                frame, data, out = -1, b"", []
                for e in batch.column("entries")[k].as_py():
                    if e["frame"] != frame:
                        if out:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        frame, out = e["frame"], []
                        start, size, whole = table_[frame]
                        data = zstd.decompress(archive[start : start + size], max_output_size=whole)
                    r = parse_record(data, e["offset"])
                    if r["record_id"] != e["record_id"] or r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]:
                        raise ValueError(f"record {e['record_id']} isn't what the index and digest say")
                    out.append(r)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return packed.select("archive", "entries").mapInArrow(read, RECORDS)


def with_roles(pages: DataFrame, payload: str = "html", page_id: str = "page_id", uri: str | None = "url", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records of pages: of equal payloads of ``least`` bytes or more, that of the largest id is the response, the others refer to it.

    Of rows that share the largest id the last is the response. Null payloads are empty.
    Only digests and ids are grouped, and those that are there once aren't joined to; a
    digest that a third of all pages share is one row on the grouped side, and Spark splits
    the other.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    src = pages.select(F.col(page_id).alias("record_id"), (F.col(uri) if uri else F.lit(None).cast("string")).alias("uri"), body.alias("payload"))
    src = src.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload"), "row": F.monotonically_increasing_id()})
    best = src.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max(F.struct("record_id", "row")).alias("b"), F.count("*").alias("k")).where("k > 1").select("digest", "n", F.col("b.record_id").alias("response"), F.col("b.row").alias("response_row"))
    both = src.join(best, ["digest", "n"], "left")
    other = F.col("response") != F.col("record_id")  # rows of the same id, or without one, are responses too
    return both.select("record_id", "row", "uri", F.when(F.coalesce(other, F.lit(False)), None).otherwise(F.col("payload")).alias("payload"), "digest", F.when(other, F.col("response")).alias("refers_to"), F.when(other, F.col("response_row")).alias("refers_row"))


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write the records of ``pages`` to bundles in the shared folder; the table of bundles."""
    return table(bundles(with_roles(pages, **columns)), "warc-bundles")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the archives of ``pages`` as read back.

    Null html is an empty payload; empty and short payloads are all responses; rows
    that repeat a page_id keep a record each; null ids keep theirs, and no other record
    refers to them unless all equal ones have none; long payloads are written whole; other
    columns are not read, so that their names can't clash; an empty table gives no rows. A
    revisit's size is that of the record it refers to, whose digest must be its own.
    """
    found = read_bundles(archive(pages, **columns)).select("record_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("n"))
    found = table(found, "warc-records")
    # of rows that repeat an id all but payload may differ: (id, digest) names what is referred to
    target = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "digest").agg(F.max("n").alias("whole"))
    out = found.join(target, ["refers_to", "digest"], "left")
    return out.select(
        F.col("record_id").alias("page_id"),
        F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.col("whole")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
