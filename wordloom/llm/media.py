"""Media columns: bytes stored losslessly as WebP images, read back, and described.

A payload fills the red, green and blue samples of rows of ``ROW`` bytes; its length is a multiple of that. An image has as
many columns as keep its height in the format's bound, the rest of its last row is padding that reading drops.

Each image is written with the transforms, colour cache and back-references that ``webp.encode_best`` estimates to be the shortest.

Defined cases: null text is empty; every text is padded with bytes 255 up to a positive multiple of ``ROW``; equal texts, repeated rows too, give equal
media and features; a text of any length up to the format's bound (85 by 16,384 rows of 576 bytes, 802 MB; beyond, ``ValueError``) is one image, for which
a task holds some 20 times its bytes; an empty table gives no rows; other columns pass through, and those named as one of the results get
underscores before their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import webp
from ._common import make_room, slices

ROW = 576


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


def to_pixels(payload: bytes) -> np.ndarray:
    rows = len(payload) // ROW
    wide = -(-rows // webp.MAX_SIDE)
    payload += b"\xff" * (-rows % wide * ROW)
    a = np.frombuffer(payload, dtype=np.uint8).reshape(-1, wide * ROW // 3, 3).astype(np.uint32)
    return np.uint32(0xFF000000) | a[..., 0] << np.uint32(16) | a[..., 1] << np.uint32(8) | a[..., 2]


def to_payload(px: np.ndarray, size: int) -> bytes:
    return np.stack([px >> np.uint32(16), px >> np.uint32(8), px], axis=-1).astype(np.uint8).tobytes()[:size]


def describe(payload: bytes) -> str:
    """A feature of the samples: mean of each channel, and a 16-bit sign pattern of a 4 x 4 thumbnail against its mean."""
    a = np.frombuffer(payload, dtype=np.uint8)
    n, more = divmod(len(a), 16)
    edges = np.arange(16) * n + np.minimum(np.arange(16), more)
    cells = np.add.reduceat(a, edges, dtype=np.int64) * 1000 // np.diff(edges, append=len(a))
    bits = "".join("1" if c * 16 > cells.sum() else "0" for c in cells)
    return "-".join(f"{int(a[k::3].sum(dtype=np.int64)) * 1000 // (len(a) // 3):06d}" for k in range(3)) + f"-{int(bits, 2):04x}"


def store(df: DataFrame, text: str = "text", into: str = "media", rows: int = 1024) -> DataFrame:
    """``df`` with ``into`` (the WebP file of the padded UTF-8 text, binary) and ``n_bytes`` (unpadded)."""
    df, moved = make_room(df, into, "n_bytes")
    text = moved.get(text, text)

    def run(batches):
        for b in slices(batches, rows):
            texts = [(t or "").encode() for t in b.column(text).to_pylist()]
            files = pa.array([webp.encode_best(to_pixels(padded(t))) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, files, pa.array(map(len, texts), pa.int64())], names=[*b.schema.names, into, "n_bytes"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType()), T.StructField("n_bytes", T.LongType())]))


def load(df: DataFrame, media: str = "media", n_bytes: str = "n_bytes", pixel_bytes: int = 8 << 20, rows: int = 2048) -> DataFrame:
    """``df`` with ``payload`` (the padded bytes, decoded) and ``feature``; images go together up to ``pixel_bytes`` of media."""
    df, moved = make_room(df, "payload", "feature")
    media, n_bytes = moved.get(media, media), moved.get(n_bytes, n_bytes)

    def run(batches):
        for whole in slices(batches, rows):
            sizes = whole.column(n_bytes).to_pylist()
            first = 0
            while first < len(sizes):
                last, held = first, 0
                while last < len(sizes) and (last == first or held + sizes[last] <= pixel_bytes):
                    held += sizes[last]
                    last += 1
                b = whole.slice(first, last - first)
                images = webp.decode_many(b.column(media).to_pylist())
                payloads = [to_payload(px, -(-max(1, n) // ROW) * ROW) for px, n in zip(images, sizes[first:last], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary()), pa.array(map(describe, payloads), pa.string())], names=[*b.schema.names, "payload", "feature"])
                first = last

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))
