"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of bounded size; each frame is compressed on its own, so any can be read without the ones
before it. A bundle is a run of frames followed by a seek table in a skippable frame (sizes of every frame, packed and
unpacked), which makes it a plain ``.warc.zst`` for readers that don't know the table. An index maps record identifiers to
(frame, offset in the frame, length). Bundles are rows of a binary column: Spark's own writers put them wherever the cluster
stores data, and a lost task writes its bundles again. Payloads that were seen before become ``revisit`` records without
payload, which name the record that holds it.

Defined cases: null payload is an empty one; payloads shorter than ``min_bytes`` are never revisits; equal payloads with equal
ids (repeated rows) are all responses; null ids are revisits of an equal payload that has an id; a payload of any length is one record, and one longer than a
frame has a frame of its own; an empty table gives no bundle; other columns pass through ``digests``, and those named as one of its results get
underscores before their names.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, make_room, slices, workspace, written

# The seekable format's skippable magic and its footer's, the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

BUNDLE = T.StructType([
    T.StructField("bundle_id", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("n_frames", T.LongType()),
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("record_id", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
])
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType()),
])


#: Digests of the largest list of copied payloads that is broadcast, at some 150 bytes each.
BROADCAST_ROWS = 1 << 18


def digests(df: DataFrame, record_id: str, payload: str, min_bytes: int = 1000) -> DataFrame:
    """Adds ``digest``, ``payload_length`` and ``refers_to`` (the id of the record that holds an equal payload, where another does).

    Only digests are shuffled to find copies. While their list is short it is broadcast, and payloads stay where they are.
    """
    if {record_id.lower(), payload.lower()} & {"digest", "payload_length", "refers_to"}:
        raise ValueError("the columns of ids and payloads can't be named as one of the results")
    df, _ = make_room(df, "digest", "payload_length", "refers_to")
    kept_, n_ = free_name("_kept", df.columns), free_name("_n", df.columns)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    x = df.withColumns({"digest": F.sha1(body), "payload_length": F.octet_length(body).cast("long")})
    long = df.select(F.col(record_id), F.sha1(body).alias("digest"), F.octet_length(body).alias(n_)).where(F.col(n_) >= min_bytes)
    # Copies only; aggregated before the shuffle, so a hot payload is one row for each task.
    kept = long.groupBy("digest").agg(F.max(record_id).alias(kept_), F.count("*").alias(n_)).where(F.col(n_) > 1).drop(n_)
    kept = written(kept, workspace(df.sparkSession, "copies"))
    x = x.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "digest", "left")
    other = F.col(kept_).isNotNull() & (F.col("payload_length") >= min_bytes) & ~F.col(record_id).eqNullSafe(F.col(kept_))
    return x.withColumn("refers_to", F.when(other, F.col(kept_))).drop(kept_)


def record(record_id: str, uri: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit where ``refers_to`` is given."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((uri or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Payload-Length: {length}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of ``RECORD`` from one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(h["content-length"])]
    if h["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("a record's block digest doesn't match")
    bare = lambda s: None if s is None else s[len("<urn:record:") : -1]
    revisit = h["warc-type"] == "revisit"
    return {"record_id": bare(h["warc-record-id"]), "record_type": h["warc-type"], "uri": h["warc-target-uri"], "refers_to": bare(h.get("warc-refers-to")), "digest": h["warc-payload-digest"].removeprefix("sha1:"), "payload_length": int(h["x-payload-length"]), "payload": None if revisit else block.partition(b"\r\n\r\n")[2]}


class Bundler:
    """Gathers records into frames, frames into a bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[tuple[str, int, int, int]] = []
        self.open, self.held, self.total = [], 0, 0

    def add(self, record_id: str, data: bytes) -> None:
        if self.held and self.held + len(data) > self.frame_bytes:
            self.cut()
        self.entries.append((record_id, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        self.total += len(data)

    def cut(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def close(self) -> tuple[bytes, int, list]:
        self.cut()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, len(self.sizes), self.entries


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    start = len(data) - 9 - 8 * n - 8
    if magic != SEEKABLE or struct.unpack("<I", data[start : start + 4])[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, full in struct.iter_unpack("<II", data[start + 8 : -9]):
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], k: int) -> bytes:
    at, packed, full = table[k]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(1, full))


def write_bundles(df: DataFrame, record_id: str = "record_id", uri: str = "uri", payload: str = "payload", frame_bytes: int = 256 << 10, bundle_bytes: int = 32 << 20, level: int = 3, rows: int = 256) -> DataFrame:
    """Bundles (``BUNDLE``) of the rows of ``digests``; a task holds one bundle at a time. Payloads are strings."""

    def run(batches):
        part, made, b = TaskContext.get().partitionId(), 0, Bundler(frame_bytes, level)

        def closed():
            data, n, entries = b.close()
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
            rows = [dict(zip(("record_id", "frame", "offset", "length"), e, strict=True)) for e in entries]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{made:06d}"]), pa.array([data], pa.binary()), pa.array([n], pa.int64()), pa.array([rows], kind)], names=BUNDLE.names)

        for batch in slices(batches, rows):
            for own, u, body, digest, length, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = "" if own is None else str(own)
                b.add(own, record(own, u, (body or "").encode(), digest, length, None if refers is None else str(refers)))
                if b.total >= bundle_bytes:
                    yield closed()
                    made, b = made + 1, Bundler(frame_bytes, level)
        if b.entries:
            yield closed()

    return df.select(record_id, uri, payload, "digest", "payload_length", "refers_to").mapInArrow(run, BUNDLE)


def _rows(records: list[dict]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], k) for n, k in zip(RECORD.names, kinds, strict=True)], names=RECORD.names)


def read_bundles(bundles: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Records (``RECORD``), read frame by frame by the seek table and the index; ``only``: a given set of ids, whose frames alone are read."""

    def run(batches):
        for batch in slices(batches, 1):
            for data, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, k, frame, out, held = seek_table(data), -1, b"", [], 0
                for e in entries:
                    if only is not None and e["record_id"] not in only:
                        continue
                    if e["frame"] != k:
                        k, frame = e["frame"], read_frame(data, table, e["frame"])
                    out.append(parse(frame[e["offset"] : e["offset"] + e["length"]]))
                    held += e["length"]
                    if held > 8 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return bundles.select("data", "entries").mapInArrow(run, RECORD)
