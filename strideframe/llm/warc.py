"""Operator 9: WARC archives as seekable Zstandard bundles.

A task writes its records to bundles. A bundle is a series of independent frames,
each of some records, and ends with a seek table in a skippable frame (the layout
of the public seekable format: for each frame its compressed and decompressed
size, then the number of frames, a descriptor and a magic number). The index maps a
record to its bundle, frame and place within the frame. Reading goes by the index: the
seek table at a bundle's end gives the frame's offset, and that frame alone is fetched
and decompressed. A revisit's length and digest are those of the response that it
refers to, as read back.

Records with equal payloads are found by digest before anything is written: the
least page_id of a group is the response, the others revisit it.

A bundle's name is of its own attempt, and the index names the bundles that count;
what a lost or repeated task leaves is never read.

Defined cases: a null payload is an empty one; payloads under 100 bytes are always
responses; a null url is an empty one; of rows that share a page_id and a payload,
all are responses if that page_id is the least; a row without a page_id is never referred
to; very long payloads are records like any
other, in a frame of their own if need be; empty tables give no bundles; only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, cut, on_workers, shared_dir

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HEADER_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
LEAST_PAYLOAD = 100

INDEX = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("bundle", T.StringType(), False),
    T.StructField("frame", T.IntegerType(), False),
    T.StructField("place", T.IntegerType(), False),
    T.StructField("size", T.IntegerType(), False),
])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType(), False),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType(), False),
    T.StructField("payload_digest", T.StringType(), False),
    T.StructField("payload", T.BinaryType()),
])


def record_id(page_id: int | None, digest: str) -> str:
    """Rows that share a page_id have records of their own, told apart by the digest."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload, but its digest."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = payload if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + HEADER_END + block + HEADER_END


def parse(data: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """A record's headers and its block."""
    head, _, rest = bytes(data).partition(HEADER_END)
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _number(name: str | None) -> int | None:
    value = None if name is None else name.removeprefix("<urn:page:").split(":")[0]
    return None if value in (None, "none") else int(value)


class Bundle:
    """Gathers records into frames, and frames into one file's bytes."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.total = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its place there."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.close_frame()
        at = (len(self.frames), self.held)
        self.open.append(data)
        self.held += len(data)
        return at

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.total += len(frame)
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])


def seek_table(file: BinaryIO) -> list[tuple[int, int, int]]:
    """Each frame's offset, compressed and decompressed size, from the end of a bundle."""
    size = file.seek(0, 2)
    file.seek(max(0, size - 9))
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, full in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(file: BinaryIO, frame: tuple[int, int, int]) -> bytes:
    """A frame's records; nothing else of the bundle is read."""
    at, packed, full = frame
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(full, 1))


class Reader:
    """Records by their entries in the index; the last bundle and the last frame stay open."""

    def __init__(self) -> None:
        self.bundle: str | None = None
        self.frame = -1

    def __call__(self, bundle: str, frame: int, place: int, size: int) -> tuple[dict[str, str], bytes]:
        if bundle != self.bundle:
            self.file = _open(bundle)
            self.frames = seek_table(self.file)
            self.bundle, self.frame = bundle, -1
        if frame != self.frame:
            self.data, self.frame = read_frame(self.file, self.frames[frame]), frame
        return parse(self.data[place : place + size])


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _open(path: str) -> BinaryIO:
    system, at = _system(path)
    return system.open_input_file(at)


def _store(folder: str, name: str, data: bytes) -> str:
    """Puts a file into a shared folder, which may be on any file system that Arrow knows."""
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    at = posixpath.join(path, name)
    with system.open_output_stream(at + ".part") as out:
        out.write(data)
    system.move(at + ".part", at)
    return posixpath.join(folder, name)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest and refers_to.

    Groups are counted before they are joined, and only those of two or more are;
    the join is one that Spark splits where a payload has many rows.
    """
    digested = pages.withColumn("digest", F.sha2("payload", 256))
    long = F.length("payload") >= LEAST_PAYLOAD
    groups = digested.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(groups.where("n > 1 and first is not null").select(F.col("digest").alias("of"), "first"))
    return digested.join(first, (F.col("digest") == F.col("of")) & long, "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``marked`` to bundles under ``folder`` and returns their index (``INDEX``), which is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, entries, name = Bundle(), [], f"{uuid.uuid4().hex}.warc.zst"

        def flush() -> pa.RecordBatch:
            path = _store(folder, name, bundle.finish())
            ids, frames, places, sizes = zip(*entries)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(frames, pa.int32()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], names=INDEX.fieldNames()
            )

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page_id, url or "", payload, digest, refers_to)
                entries.append((page_id, *bundle.add(data), len(data)))
                if bundle.total + bundle.held >= BUNDLE_BYTES:
                    yield flush()
                    bundle, entries, name = Bundle(), [], f"{uuid.uuid4().hex}.warc.zst"
        if entries:
            yield flush()

    return cut(on_workers(marked).mapInArrow(run, INDEX))


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records (``RECORDS``) that ``index`` names, each from its frame; a payload only where it is asked for, and of responses.

    A revisit whose response ``index`` doesn't name has no length.
    """
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            rows, held = [], 0
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                headers, block = read(*entry)
                response = headers["WARC-Type"] == "response"
                digest = hashlib.sha256(block).hexdigest() if response else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], _number(headers.get("WARC-Refers-To")), len(block) if response else None, digest, block if payloads else None))
                held += len(block) if payloads else 0
                if len(rows) == ROWS or held > BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=RECORDS.fieldNames())
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=RECORDS.fieldNames())

    entries = index.select("bundle", "frame", "place", "size").sortWithinPartitions("bundle", "frame", "place")
    records = on_workers(entries).mapInArrow(run, T.StructType([*RECORDS.fields[:4], T.StructField("payload_bytes", T.LongType()), *RECORDS.fields[5:]]))
    if not payloads:
        records = cut(records)
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    first = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full"))
    first = first.where("refers_to is not null").join(revisits.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi").distinct()
    found = revisits.join(first, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("full"))
    return responses.unionByName(found.select(*RECORDS.fieldNames()))


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes ``pages`` as WARC bundles and returns their index."""
    folder = folder or posixpath.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    plain = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return write_archives(mark_revisits(plain), folder)
