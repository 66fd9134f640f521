"""Hierarchical multi-length packing of tokenised documents.

Within each partition, as batches arrive:

1. every document gives its ids and an end id; whole windows of the largest tier are cut off at once;
2. what is left is routed to the smallest tier (context size) that holds it;
3. each tier, largest first, is packed best-fit-decreasing; gaps of a window are filled with whole documents
   of its own or shorter tiers, and the last gap by cutting one;
4. finished sequences of a tier are dealt into step groups of equal token counts, in serpentine order of their
   attention cost, so that the groups of a tier cost nearly the same.

Every tier is a power of two and every window leaves full, so nothing is padded. The ids that are left when a
partition ends leave as sequences of falling powers of two. There is no shuffle: ids never leave the task, the
buffer is bounded, and a lost task repeats to the same rows (sequence ids derive from the partition and a counter).

Defined cases: null or empty text gives the end id alone; a text of any length is cut; repeated rows are packed each; pieces of equal length go
in order of arrival; ids may be null, and of any type; an empty table gives no rows; columns other than the two named don't matter.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right, insort
from struct import Struct

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import SteadyMemo, resident, slices
from .bpe import byte_letters

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()), T.StructField("ids", T.BinaryType()),
])

#: Anything but letters below U+0250, which are composed already and lower-case alike everywhere, and plain white space.
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-\u024f]|<\\|")
#: Fixed value: the pattern by which the vocabulary splits texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def plain_pieces() -> re.Pattern:
    """``SPLIT`` for lower-case texts without ``ODD`` characters, as plain character classes."""
    plain = sorted({c for i in (*range(0x21, 0x7F), *range(0xA1, 0x250)) for c in chr(i).lower()})
    letters, numbers = ("".join(re.escape(c) for c in plain if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
    return re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^\\s{letters}{numbers}]+")


class WordTokenizer:
    """Ids by a vocabulary with word ends, each distinct piece given to the library's model once while it is remembered.

    Texts with ``ODD`` characters or what may be an added token go to the library whole, and so do all texts of a vocabulary that splits otherwise.
    """

    def __init__(self, path: str, memo: int = 120_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        splits = json.loads(self.library.pre_tokenizer.__getstate__()).get("pretokenizers") or [{}]
        self.known = splits[0].get("pattern") == {"Regex": SPLIT}
        self.pieces = plain_pieces()
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.packed = [Struct(f"<{n}I").pack for n in range(64)]
        self.memo = SteadyMemo(self.piece, memo)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece: lower-case letters, a digit, or other characters but white space."""
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))]
        return self.packed[len(ids)](*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or not self.known:
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.pieces.findall(text.lower())))


def tokenizer(path: str) -> WordTokenizer:
    return resident(("word tokenizer", path), lambda: WordTokenizer(path))


class Packer:
    """Packs pieces ``(length, key, start)``; ``emit(tier, pieces)`` receives each full sequence."""

    def __init__(self, tiers: tuple[int, ...], emit):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers, self.emit = sorted(tiers), emit
        self.open: dict[int, list] = {t: [] for t in self.tiers}  # sorted by length

    def add(self, key: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.emit(top, [(top, key, start)])
            start += top
        if length > start:
            self._route(length - start, key, start)

    def _route(self, length: int, key: int, start: int) -> None:
        insort(self.open[self.tiers[bisect_left(self.tiers, length)]], (length, key, start))

    def held(self) -> int:
        return sum(p[0] for ps in self.open.values() for p in ps)

    def pack(self) -> list:
        """Empties the tiers into full sequences; returns the pieces of the one that stayed short."""
        short: list = []
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            sources = [self.open[t] for t in self.tiers[k::-1]]
            while self.open[tier]:
                pieces = [self.open[tier].pop()]
                gap = tier - pieces[0][0]
                while gap:
                    piece = None
                    for s in sources:  # the largest that fits, from the longest tier that has one
                        if i := bisect_right(s, (gap, 1 << 62, 0)):
                            piece = s.pop(i - 1)
                            break
                    if piece is None:  # cut the shortest of what is left
                        s = next((s for s in reversed(sources) if s), None)
                        if s is None:
                            break
                        length, key, start = s.pop(0)
                        self._route(length - gap, key, start + gap)
                        piece = (gap, key, start)
                    pieces.append(piece)
                    gap -= piece[0]
                if gap:
                    short = pieces
                else:
                    self.emit(tier, pieces)
        return short

    def finish(self) -> None:
        """Packs all, the rest into sequences of falling powers of two."""
        rest = self.pack()
        total = sum(p[0] for p in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            pieces, room = [], size
            while room:
                length, key, start = rest.pop(0)
                take = min(length, room)
                pieces.append((take, key, start))
                if take < length:
                    rest.insert(0, (length - take, key, start + take))
                room -= take
            self.emit(size, pieces)


def step_groups(sequences: list, step_tokens: int) -> list[int]:
    """A group for each (tier, pieces): equal tokens to a group of a tier, costs dealt in serpentine order."""
    out = [0] * len(sequences)
    first = 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = sorted((i for i, (t, _) in enumerate(sequences) if t == tier), key=lambda i: -sum(p[0] ** 2 for p in sequences[i][1]))
        n = -(-len(own) * tier // step_tokens)
        for j, i in enumerate(own):
            lap, at = divmod(j, n)
            out[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return out


def pack(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 32_768, buffer_tokens: int = 1 << 21, rows: int = 512) -> DataFrame:
    """One row for each piece of a document in a sequence: ``SCHEMA``.

    ``ids`` holds the piece's ids (packed little-endian unsigned 32-bit), ``tier`` the length of its sequence,
    ``step_group`` the group of sequences it trains with. ``buffer_tokens`` bounds what a task holds.
    """
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *SCHEMA.fields[1:]])
    own_kind = to_arrow_type(schema["doc_id"].dataType)

    def run(batches):
        encode, end = tokenizer(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        docs: dict[int, tuple] = {}  # key -> doc_id, ids
        done: list = []
        counts = [0, 0, 0]  # sequences, groups, documents
        packer = Packer(tiers, lambda tier, pieces: done.append((tier, pieces)))

        def rows_of():
            groups = step_groups(done, step_tokens)
            cols: list[list] = [[] for _ in SCHEMA]
            for (tier, pieces), group in zip(done, groups, strict=True):
                at = 0
                for length, key, start in pieces:
                    own, ids = docs[key]
                    for c, v in zip(cols, (own, start, length, len(ids) // 4, base + counts[0], at, tier, base + counts[1] + group, ids[4 * start : 4 * (start + length)]), strict=True):
                        c.append(v)
                    at += length
                counts[0] += 1
            counts[1] += max(groups, default=-1) + 1
            done.clear()
            kinds = [own_kind] + [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
            for i in range(0, len(cols[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], k) for c, k in zip(cols, kinds, strict=True)], names=SCHEMA.names)

        held = 0
        for b in slices(batches, rows):
            for own, body in zip(b.column(doc_id).to_pylist(), b.column(text).to_pylist(), strict=True):
                ids = encode(body) + end
                docs[counts[2]] = (own, ids)
                packer.add(counts[2], len(ids) // 4)
                counts[2] += 1
                held += len(ids) // 4
                if held >= buffer_tokens:
                    rest = packer.pack()
                    yield from rows_of()
                    docs = {key: docs[key] for _, key, _ in rest}
                    for length, key, start in rest:
                        packer._route(length, key, start)
                    held = sum(p[0] for p in rest)
        packer.finish()
        yield from rows_of()

    return df.select(doc_id, text).mapInArrow(run, schema)
