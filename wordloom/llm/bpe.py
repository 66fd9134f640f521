"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding. All token byte strings stand in one Aho-Corasick automaton; a scan of a piece of text gives the
longest token that starts at each byte. The encoder walks left to right, takes the longest token that is
*compatible* with the one before it (the two would come out of the merge rules side by side), falls back to
the token's next shorter prefix, and steps back where nothing fits. A byte position that proved a dead end is
never entered again, so a piece takes time linear in its length. Two tokens are compatible when undoing their merges from
the inner edge outward never meets a merge that the rules would have made earlier; answers are kept in a
table of pairs.

Decoding. One byte blob holds every token's bytes, one table holds the offsets; a text is a gather.

Defined cases: null text encodes as the empty text (no ids); added tokens (as ``<|endoftext|>``) that occur in
a text become their id, as in the library's default; ids that don't form UTF-8 decode with U+FFFD; ties don't arise (BPE is a
function of the text), and repeated rows get equal ids; a text of any length is encoded whole, a task holding its ids; an empty table gives no rows; other
columns pass through, and one named as the result gets underscores before its name. A vocabulary with another way of pre-tokenisation, a normaliser or
a model other than byte-level BPE is refused (``ValueError``).
"""

from __future__ import annotations

import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SteadyMemo, make_room, resident, slices

# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"


#: Anything but characters below U+0250.
ODD = re.compile("[^\x00-\u024f]")


def plain_pieces() -> re.Pattern:
    """``PATTERN`` for texts without ``ODD`` characters, as plain character classes."""
    plain = [chr(i) for i in range(0x250)]
    letters, numbers = ("".join(re.escape(c) for c in plain if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the printable alphabet in which byte-level vocabularies are written."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str, memo: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or spec["model"]["type"] != "BPE":
            raise ValueError("not a vocabulary of plain byte-level BPE")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        # Ranks: single bytes first, then merges in order of priority.
        singles = sorted((v, k) for k, v in vocab.items() if len(k) == 1)
        names = [k for _, k in singles] + [a + b for a, b in merges]
        rank = {}
        for i, n in enumerate(names):
            rank.setdefault(n, i)
        self.ids = np.array([vocab[n] for n in names], dtype="<u4")
        self.packed = [i.to_bytes(4, "little") for i in self.ids.tolist()]
        self.tokens = [raw(n) for n in names]
        self.split = [(i, i) for i in range(len(singles))] + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {s: i for i, s in enumerate(self.split) if i >= len(singles)}
        self.by_bytes = {t: i for i, t in reversed(list(enumerate(self.tokens)))}
        self.auto = ahocorasick.Automaton()
        for t, i in self.by_bytes.items():
            self.auto.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.auto.make_automaton()
        self.size = [len(t) for t in self.tokens]
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [next((i for n in range(len(t) - 1, 0, -1) if (i := self.by_bytes.get(t[:n])) is not None), -1) for t in self.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        added = spec.get("added_tokens") or []
        self.added = {a["content"]: a["id"] for a in added}
        self.added_at = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        # Decoding: blob and offsets by id; added tokens decode to their own text.
        by_id = {int(i): t for i, t in zip(self.ids, self.tokens, strict=True)} | {i: s.encode() for s, i in self.added.items()}
        size = max(by_id) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for i, t in by_id.items():
            lengths[i] = len(t)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pieces = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.plain_pieces = plain_pieces()
        self.of_piece = SteadyMemo(self._piece, 3 * memo // 2)
        self.of_chunk = SteadyMemo(self._chunk, memo // 2)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave these two tokens side by side."""
        merged, split = self.merged.get, self.split
        a, b, bound, out = left, right, len(split), True
        while True:
            joined = merged((a, b))
            if joined is not None and joined < bound:
                out = False
                break
            # Undo the later of the two merges at the inner edge; a single byte has none.
            inner_a, inner_b = split[a][1], split[b][0]
            if a > b and inner_a != a or inner_b == b:
                if inner_a == a:
                    break
                a, bound = inner_a, a
            else:
                b, bound = inner_b, b + 1
        if len(self.pairs) >= 250_000:
            self.pairs.clear()
        self.pairs[left, right] = out
        return out

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ranks of one pre-token."""
        whole = self.by_bytes.get(piece)
        if whole is not None:  # the longest match at once, with nothing before it
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (back, token) in self.auto.iter(piece.decode("latin-1")):
            longest[end - back] = token  # later ends overwrite: the longest stays
        known, size, shorter, out, pos, last, token = self.pairs.get, self.size, self.shorter, [], 0, -1, longest[0]
        dead = bytearray(n + 1)
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = known((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos, last, token = end, token, longest[end]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks some byte")
                dead[pos] = 1
                token = out.pop()
                pos -= size[token]
                last = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.packed[i] for i in self.encode_bytes(piece.encode())])

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.of_piece.__getitem__, self.pieces.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added_at is not None and self.added_at.search(text):
            return b"".join(int(self.added[s]).to_bytes(4, "little") if i % 2 else self._plain(s) for i, s in enumerate(self.added_at.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not ODD.search(text):
            return b"".join(map(self.of_piece.__getitem__, self.plain_pieces.findall(text)))
        return b"".join(map(self.of_chunk.__getitem__, self.chunks.findall(text)))

    def decode(self, ids: bytes | None) -> str:
        """The text of packed ids; unknown ids give nothing."""
        x = np.frombuffer(ids or b"", dtype="<u4").astype(np.int64)
        x = x[x < len(self.offset) - 1]
        start, sizes = self.offset[x], self.offset[x + 1] - self.offset[x]
        ends = np.cumsum(sizes)
        at = np.repeat(start - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.blob[at].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec, with its memos, for each Python worker."""
    return resident(("codec", path), lambda: Codec(path))


def _mapped(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, make, rows: int) -> DataFrame:
    if source not in df.columns:
        raise ValueError(f"no column {source}")
    df, moved = make_room(df, name)
    source = moved.get(source, source)

    def run(batches):
        f = make()
        for b in slices(batches, rows):
            values = pa.array(map(f, b.column(source).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", into: str = "ids", rows: int = 512) -> DataFrame:
    """Adds ``into``: the ids of ``text`` as packed little-endian unsigned 32-bit integers (binary)."""
    return _mapped(df, text, into, T.BinaryType(), pa.binary(), lambda: codec(vocabulary).encode, rows)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded", rows: int = 512) -> DataFrame:
    """Adds ``into``: the text that packed ``ids`` stand for; null ids give an empty text."""
    return _mapped(df, ids, into, T.StringType(), pa.string(), lambda: codec(vocabulary).decode, rows)


def n_ids(ids: str = "ids"):
    """Number of packed ids in a column."""
    return (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")
