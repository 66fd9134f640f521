"""Lossless WebP (VP8L): an encoder, a complete scalar decoder, and a decoder that walks many images in lockstep.

The scalar decoder reads everything the format has: simple and normal prefix codes, entropy images, back-references with the
near-distance map, colour caches, and the predictor, cross-colour, subtract-green and palette transforms, whose inverses
are applied in reverse order. The encoder writes length-limited canonical prefix codes, back-references, a colour cache and each transform
where asked; ``encode_best`` asks for those that make an image smaller by an estimate of its bits. Images with one code group (what the
encoder writes) are decoded together: each numpy step gives one pixel of every image that still has some, be it a literal, from the cache,
or part of a copy.

Pixels are unsigned 32-bit ARGB numbers in an array of (height, width). Bits are packed some thousand codes at a time, so memory is a small
multiple of the pixels.
"""

from __future__ import annotations

import copy
import functools
import struct

import numpy as np

# Fixed values of the format: order of code length codes, and the near-distance map (x, y) of codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
#: Longest codes the encoder makes: for green, with lengths and cache entries, and for other symbols. A decoding table has 2 ** limit entries.
GREEN_LIMIT, LIMIT = 12, 10
#: Code lengths that the encoder gives to code lengths (0 to 12, and runs of zeros, 17 and 18): a complete code near their usual counts.
OWN_LENGTHS = tuple({5: 3, 6: 3, 7: 3, 8: 3, 17: 3, 18: 4, 4: 4, 9: 4, 10: 4, 0: 5, 3: 5, 1: 6, 2: 6, 11: 6, 12: 6}.get(i, 0) for i in range(19))


def _reversed15() -> np.ndarray:
    v, out = np.arange(1 << 15, dtype=np.int64), np.zeros(1 << 15, dtype=np.int64)
    for i in range(15):
        out |= ((v >> i) & 1) << (14 - i)
    return out


#: Each 15-bit number with its bits in reverse.
REVERSED = _reversed15()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical prefix code, bit-reversed as they stand in the stream."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    step = np.int64(1) << (15 - lengths[order].astype(np.int64))
    at = np.cumsum(step) - step
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = REVERSED[at]  # codes stand in the top bits of 15
    return codes


def table_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 4 | length by the next ``bits`` bits, bits). One symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        return np.zeros(1, dtype=np.int64), 0
    if len(used) == 1:
        return np.array([used[0] << 4], dtype=np.int64), 0
    bits = int(lengths.max())
    if int((np.int64(1) << (bits - lengths[used].astype(np.int64))).sum()) != 1 << bits:
        raise ValueError("incomplete prefix code")
    # In order of the code from its first bit on, each symbol fills a run; reversing the index gives the stream's order.
    order = used[np.argsort(lengths[used], kind="stable")]
    runs = np.repeat(order << 4 | lengths[order], np.int64(1) << (bits - lengths[order].astype(np.int64)))
    return runs[REVERSED[: 1 << bits] >> (15 - bits)], bits


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a complete prefix code near the counts' entropy: Shannon's, then shortened until the code is full."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    share = counts[used] / counts[used].sum()
    n = np.clip(np.ceil(-np.log2(share)), 1, limit).astype(np.int64)
    room = (1 << limit) - int((1 << (limit - n)).sum())
    while room < 0:  # the limit cut some short: lengthen the rarest that can grow
        grow = np.flatnonzero(n < limit)
        i = grow[np.lexsort((grow, share[grow], -n[grow]))[0]]
        room += 1 << (limit - n[i] - 1)
        n[i] += 1
    order, n = np.argsort(-share, kind="stable").tolist(), n.tolist()
    while room > 0:
        for i in order:
            if n[i] > 1 and (cost := 1 << (limit - n[i])) <= room:
                n[i] -= 1
                room -= cost
                if not room:
                    break
    out[used] = n
    return out


class Writer:
    """Bits, least significant first, packed ``SOME`` codes at a time."""

    SOME = 1 << 15

    def __init__(self):
        self.out, self.carry, self.filled = bytearray(), 0, 0
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(value)
        self.sizes.append(bits)

    def many(self, values: np.ndarray, bits: np.ndarray) -> None:
        if self.values:
            v, n, self.values, self.sizes = np.array(self.values, dtype=np.int64), np.array(self.sizes, dtype=np.int64), [], []
            self.many(v, n)
        for k in range(0, len(values), self.SOME):
            self._pack(values[k : k + self.SOME], bits[k : k + self.SOME])

    def _pack(self, values: np.ndarray, bits: np.ndarray) -> None:
        ends = np.cumsum(bits)
        start, total = ends - bits + self.filled, int(ends[-1]) + self.filled
        at, moved = start >> 5, values.astype(np.uint64) << (start & 31).astype(np.uint64)
        # Codes don't overlap, so sums within a word are exact.
        size = (total >> 5) + 2
        words = np.bincount(at, weights=moved & np.uint64(0xFFFFFFFF), minlength=size) + np.bincount(at + 1, weights=moved >> np.uint64(32), minlength=size)
        words[0] += self.carry
        data = words.astype("<u4").tobytes()
        self.out += data[: total >> 3]
        self.carry, self.filled = data[total >> 3], total & 7

    def bytes(self) -> bytes:
        self.many(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        return bytes(self.out) + (bytes([self.carry]) if self.filled else b"")


OWN_CODES = canonical(np.array(OWN_LENGTHS)).tolist()


def _zeros(g: int) -> tuple[int, int, int]:
    """(symbols, their bits as a number, how many bits) of a run of ``g`` zero lengths."""
    if g < 3:
        return g, sum(OWN_CODES[0] << (k * OWN_LENGTHS[0]) for k in range(g)), g * OWN_LENGTHS[0]
    s, extra, n = (17, g - 3, 3) if g < 11 else (18, g - 11, 7)
    return 1, OWN_CODES[s] | extra << OWN_LENGTHS[s], OWN_LENGTHS[s] + n


#: Of runs of up to 138 zeros.
ZEROS = np.array([_zeros(g) for g in range(139)]).T


def write_code(w: Writer, lengths: np.ndarray) -> None:
    """Describes a prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (len(used) == 0 or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)  # one symbol
        symbol = int(used[0]) if len(used) else 0
        w.put(int(symbol > 1), 1)
        w.put(symbol, 8 if symbol > 1 else 1)
        return
    n = max(i + 1 for i, s in enumerate(LENGTH_ORDER) if OWN_LENGTHS[s])
    w.values += [0, n - 4]
    w.sizes += [1, 4]
    w.values += [OWN_LENGTHS[s] for s in LENGTH_ORDER[:n]]
    w.sizes += [3] * n
    # Before each symbol the zeros, by runs of 17 and 18, then its own length: one number for both.
    gap = used.copy()
    gap[1:] -= used[:-1] + 1
    whole = np.maximum(gap - 1, 0) // 138
    count, value, size = ZEROS[:, gap - 138 * whole]
    own = lengths[used]
    symbols = int(count.sum() + whole.sum()) + len(used)
    bits = max(2, (max(2, symbols) - 2).bit_length())
    bits += bits % 2
    w.values += [1, (bits - 2) // 2, max(2, symbols) - 2]  # number of code length symbols that follow
    w.sizes += [1, 3, bits]
    values, sizes = (value | np.array(OWN_CODES)[own] << size).tolist(), (size + np.array(OWN_LENGTHS)[own]).tolist()
    if whole.any():  # runs of more than 138 zeros, one after another
        for i in np.flatnonzero(whole)[::-1].tolist():
            values[i:i], sizes[i:i] = [int(ZEROS[1, 138])] * int(whole[i]), [int(ZEROS[2, 138])] * int(whole[i])
    w.values += values
    w.sizes += sizes
    if symbols < 2:
        w.put(OWN_CODES[0], OWN_LENGTHS[0])


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


#: The farthest and the longest that a back-reference reaches, and the pixels from which it is worth its bits.
FAR, LONGEST, SHORTEST = (1 << 20) - 120, 4096, 4


def find_matches(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats in a flat image, in order, none overlapping: runs of pixels whose last equal four lie equally far back."""
    n = len(px)
    if n < 2 * SHORTEST:
        return []
    key = px[: n - 3].astype(np.uint64)
    for k in (1, 2, 3):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[k : n - 3 + k]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    at, back = order[same + 1], order[same]
    near = at - back <= FAR
    at, back = at[near], back[near]
    if not len(at):
        return []
    order = np.argsort(at)
    at, far = at[order], (at - back)[order]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] - at[:-1] != 1) | (far[1:] != far[:-1])]))
    out, done, ends = [], 0, np.append(first[1:], len(at))
    for start, run, d in zip(at[first].tolist(), (ends - first).tolist(), far[first].tolist(), strict=True):
        end = start + run + 3
        start = max(start, done)
        while end - start >= SHORTEST:
            length = min(LONGEST, end - start)
            if (px[start : start + length] != px[start - d : start - d + length]).any():  # keys were equal by chance
                break
            out.append((start, length, d))
            start = done = start + length
    return out


def cache_hits(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cache entry of each pixel, whether it holds the pixel by then)."""
    at = (px * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - bits)
    order = np.argsort(at, kind="stable")
    hit = np.zeros(len(px), dtype=bool)
    hit[order[1:]] = (at[order[1:]] == at[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    return at, hit


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols with these counts take, their code aside."""
    c = counts[counts > 0]
    if len(c) < 2:
        return 0.0
    n = int(c.sum())
    return float(n * np.log2(n) - c @ np.log2(c))


class Tokens:
    """A flat image as literals, cache entries and back-references."""

    def __init__(self, px: np.ndarray, cache_bits: int, matches: list[tuple[int, int, int]], width: int):
        self.px, self.cache_bits = px, 0
        own, self.literal = np.ones(len(px), dtype=bool), np.ones(len(px), dtype=bool)
        for start, length, _ in matches:
            own[start + 1 : start + length] = False
            self.literal[start : start + length] = False
        self.green = (px >> np.uint32(8) & np.uint32(255)).astype(np.int16)
        self.matches = [(*prefix_of(length), *prefix_of(1 if d == width else 2 if d == 1 else d + 120)) for _, length, d in matches]
        self.green[[m[0] for m in matches]] = [256 + m[0] for m in self.matches]
        self.at = np.flatnonzero(own)  # the pixel at which each token begins
        if cache_bits:
            self._cache(cache_bits)
        self._count()

    def _cache(self, bits: int) -> None:
        at, hit = cache_hits(self.px, bits)
        hit &= self.literal
        self.cache_bits, self.green, self.literal = bits, np.where(hit, at + 280, self.green).astype(np.int16), self.literal & ~hit

    def with_cache(self, bits: int) -> Tokens:
        out = copy.copy(self)
        out._cache(bits)
        out._count()
        return out

    def _count(self) -> None:
        channels = self.px[self.literal].astype("<u4").view(np.uint8).reshape(-1, 4)
        self.counts = [np.bincount(self.green[self.at], minlength=280 + (1 << self.cache_bits if self.cache_bits else 0))]
        self.counts += [np.bincount(channels[:, k], minlength=256) for k in (2, 0, 3)]
        self.counts.append(np.bincount([m[3] for m in self.matches], minlength=40))
        # Red and blue of a text are alike (and of a small image, too few to tell): one code for both is made, told and read once.
        if len(channels) < 1024 or np.abs(self.counts[1] - self.counts[2]).sum() <= 0.3 * len(channels):
            self.counts[1] = self.counts[2] = self.counts[1] + self.counts[2]

    def bits(self) -> float:
        """About how many bits the image takes."""
        told = sum(7 * n + 30 for n in map(np.count_nonzero, self.counts) if n > 1)
        red_blue = entropy(self.counts[1]) if self.counts[1] is self.counts[2] else entropy(self.counts[1]) + entropy(self.counts[2])
        return told + red_blue + sum(entropy(self.counts[k]) for k in (0, 3, 4)) + sum(m[2] + m[5] for m in self.matches)

    def write(self, w: Writer) -> None:
        codes = []
        for k, counts in enumerate(self.counts):
            if k == 2 and counts is self.counts[1]:
                w.values += told[0]
                w.sizes += told[1]
                codes.append(codes[1])
                continue
            lengths, told = code_lengths(counts, LIMIT if k else GREEN_LIMIT), (w.values, w.sizes)
            w.values, w.sizes = [], []
            write_code(w, lengths)
            told, w.values, w.sizes = (w.values, w.sizes), told[0] + w.values, told[1] + w.sizes
            codes.append((canonical(lengths), lengths) if np.count_nonzero(lengths) > 1 else (np.zeros_like(lengths),) * 2)
        # Two numbers a token: what green, red and blue say, or a length; then alpha, or a distance. Mostly the second is empty for all.
        done, step = 0, Writer.SOME // 2
        both = bool(self.matches) or bool(codes[3][1].any())
        for k in range(0, len(self.at), step):
            at = self.at[k : k + step]
            symbol = self.green[at]
            value, size = np.zeros((len(at), 1 + both), dtype=np.int64), np.zeros((len(at), 1 + both), dtype=np.int64)
            first, bits = codes[0][0][symbol], codes[0][1][symbol]
            literal = np.flatnonzero(self.literal[at])
            shown = self.px[at[literal]].astype("<u4").view(np.uint8).reshape(-1, 4)
            for slot, c in ((1, shown[:, 2]), (2, shown[:, 0])):
                first[literal] |= codes[slot][0][c] << bits[literal]
                bits[literal] += codes[slot][1][c]
            if codes[3][1].any():
                value[literal, 1], size[literal, 1] = codes[3][0][shown[:, 3]], codes[3][1][shown[:, 3]]
            if self.matches:
                for i in np.flatnonzero((symbol >= 256) & (symbol < 280)).tolist():
                    _, extra, n, prefix, far_extra, far_n = self.matches[done]
                    first[i] |= extra << int(bits[i])
                    bits[i] += n
                    value[i, 1], size[i, 1] = int(codes[4][0][prefix]) | far_extra << int(codes[4][1][prefix]), codes[4][1][prefix] + far_n
                    done += 1
            value[:, 0], size[:, 0] = first, bits
            w.many(value.ravel(), size.ravel())


def _write_image(w: Writer, px: np.ndarray | Tokens, main: bool, cache_bits: int = 0, matches: bool = False, width: int = 0) -> None:
    """Colour cache, code group and entropy-coded pixels of a flat image."""
    t = px if isinstance(px, Tokens) else Tokens(px.astype(np.uint32), cache_bits, find_matches(px.astype(np.uint32)) if matches else [], width)
    w.put(int(t.cache_bits > 0), 1)
    if t.cache_bits:
        w.put(t.cache_bits, 4)
    if main:
        w.put(0, 1)  # one code group
    t.write(w)


def split_channels(px: np.ndarray) -> list[np.ndarray]:
    """A, R, G, B as signed numbers."""
    return [(px >> s & 255).astype(np.int64) for s in (24, 16, 8, 0)]


def joined(a, r, g, b) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | (b & 255)).astype(np.uint32)


def _signed(x):
    return (x & 255) - ((x & 128) << 1)


def _cross(px: np.ndarray, data: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Cross-colour transform (sign -1) or its inverse (+1)."""
    h, w = px.shape
    ys, xs = np.arange(h) >> bits, np.arange(w) >> bits
    e = data[ys[:, None], xs[None, :]]
    red_blue, green_blue, green_red = (_signed((e >> s & 255).astype(np.int64)) for s in (16, 8, 0))
    a, r, g, b = split_channels(px)
    moved = r + sign * (green_red * _signed(g) >> 5)
    b = b + sign * (green_blue * _signed(g) >> 5)
    b = b + sign * (red_blue * _signed(moved if sign > 0 else r) >> 5)
    return joined(a, moved, g, b)


def _predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    ch = lambda v: (v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 0 or mode > 13:
        return 0xFF000000
    half = lambda p, q: [(x + y) >> 1 for x, y in zip(p, q, strict=True)]
    clip = lambda x: max(0, min(255, x))
    le, t, tl, tr = ch(left), ch(top), ch(top_left), ch(top_right)
    if mode == 5:
        c = half(half(le, tr), t)
    elif mode == 6:
        c = half(le, tl)
    elif mode == 7:
        c = half(le, t)
    elif mode == 8:
        c = half(tl, t)
    elif mode == 9:
        c = half(t, tr)
    elif mode == 10:
        c = half(half(le, tl), half(t, tr))
    elif mode == 11:
        to_left = sum(abs(t[k] - tl[k]) for k in range(4))
        to_top = sum(abs(le[k] - tl[k]) for k in range(4))
        return left if to_left < to_top else top
    elif mode == 12:
        c = [clip(x + y - z) for x, y, z in zip(le, t, tl, strict=True)]
    else:
        c = [clip(m + int((m - z) / 2)) for m, z in zip(half(le, t), tl, strict=True)]
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _add(a: int, b: int, sign: int = 1) -> int:
    return sum(((a >> s & 255) + sign * (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def _predictor(px: np.ndarray, data: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Predictor transform (sign -1) or its inverse (+1), pixel by pixel."""
    h, w = px.shape
    src, out, modes = px.ravel().tolist(), [0] * (h * w), (data >> 8 & 255).tolist()
    seen = out if sign > 0 else src  # predictions read true pixels
    for i in range(h * w):
        y, x = divmod(i, w)
        if i == 0:
            p = 0xFF000000
        elif y == 0:
            p = seen[i - 1]
        elif x == 0:
            p = seen[i - w]
        else:
            p = _predict(modes[y >> bits][x >> bits], seen[i - 1], seen[i - w], seen[i - w - 1], seen[i - w + 1])
        out[i] = _add(src[i], p, sign)
    return np.array(out, dtype=np.uint32).reshape(h, w)


def packed_width(width: int, colours: int) -> tuple[int, int]:
    """(width after palette bundling, its bits)."""
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    return -(-width // (1 << bits)), bits


def indexed(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(colours, the image of their bundled indices) of the palette transform."""
    colours, index = np.unique(px, return_inverse=True)
    narrow, bits = packed_width(px.shape[1], len(colours))
    index = np.pad(index.reshape(px.shape), ((0, 0), (0, narrow * (1 << bits) - px.shape[1]))).astype(np.int64)
    size = 8 >> bits
    g = sum(index[:, k :: 1 << bits] << (k * size) for k in range(1 << bits))
    return colours, joined(np.full_like(g, 255), 0 * g, g, 0 * g)


def smooth(px: np.ndarray) -> bool:
    """Whether neighbours are near in value (in green), as in pictures, so that predictions can pay; texts are not."""
    green = px[:8].astype("<u4").view(np.uint8)[:, 1::4].astype(np.int16)
    return green.shape[1] > 1 and px.size > 16 and float(np.abs(green[:, 1:] - green[:, :-1]).mean()) < 12


def predicted(px: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    """Transforms to try on a smooth image, with the pixels they leave: left or top as prediction, each with and without one cross-colour element."""
    out = []
    for mode in (1, 2):
        before = np.zeros_like(px)
        before[:, 1:], before[1:, 0] = px[:, :-1], px[:-1, 0]
        if mode == 2:
            before[1:, 1:] = px[:-1, 1:]
        before[0, 0] = 0xFF000000
        left = joined(*[c - d for c, d in zip(split_channels(px), split_channels(before), strict=True)])
        side = tuple(-(-n // 512) for n in px.shape)
        t = (("predictor", 9, np.full(side, mode)),)
        out.append((t, left))
        _, r, g, b = (_signed(c) for c in split_channels(left))
        slope = lambda c, g=g: int(np.clip(np.rint(32 * float((c * g).sum()) / max(1.0, float((g * g).sum()))), -128, 127)) & 255
        element = np.full(side, slope(b) << 8 | slope(r), dtype=np.uint32)
        if element.any():
            out.append(((*t, ("cross", 9, element)), _cross(left, element, 9, -1)))
    return out


#: Literals from which a cache is tried, and pixels up to which a palette is: below and above they don't pay.
CACHED, COLOURED = 2048, 1024


def encode_best(px: np.ndarray) -> bytes:
    """A WebP file with the transforms, cache and back-references that take the fewest bits, as far as an estimate from symbol counts says."""
    px = np.ascontiguousarray(px, dtype=np.uint32)
    flat, width = px.ravel(), px.shape[1]
    matches = find_matches(flat)
    tried: list[tuple[float, tuple, Tokens]] = []

    def consider(transforms: tuple, flat: np.ndarray, matches: list, width: int, more: float = 0.0) -> None:
        t = Tokens(flat, 0, matches, width)
        tried.append((more, transforms, t))
        if np.count_nonzero(t.literal) >= CACHED:
            tried.append((more, transforms, t.with_cache(min(10, len(flat).bit_length() - 2))))

    consider((), flat, matches, width)
    if len(flat) <= COLOURED and 4 * len(set(flat.tolist())) <= len(flat):
        colours, index = indexed(px)
        if len(colours) <= 256:
            table = Tokens(joined(*[np.diff(c, prepend=0) for c in split_channels(colours)]), 0, [], 0)
            consider((("palette",),), index.ravel(), find_matches(index.ravel()), index.shape[1], table.bits())
    if smooth(px):
        for transforms, left in predicted(px):
            consider(transforms, left.ravel(), find_matches(left.ravel()), width, 60.0 * len(transforms))
    _, transforms, tokens = min(tried, key=lambda x: x[0] + x[2].bits()) if len(tried) > 1 else tried[0]
    return encode(px, transforms, tokens=tokens)


def encode(px: np.ndarray, transforms: tuple = (), cache_bits: int = 0, matches: bool = False, tokens: Tokens | None = None) -> bytes:
    """A WebP file; ``tokens``: the transformed pixels' tokens, where they are known. transforms, in order: ``("green",)``, ``("predictor", bits, modes)``, ``("cross", bits, elements)``, ``("palette",)``."""
    h, width = px.shape
    if not (0 < h <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("a side must be from 1 to 16384")
    px = px.astype(np.uint32)
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(int(bool((px >> 24 != 255).any())), 1)
    w.put(0, 3)
    for name, *args in transforms:
        w.put(1, 1)
        if name == "green":
            w.put(GREEN, 2)
            a, r, g, b = split_channels(px)
            px = joined(a, r - g, g, b - g)
        elif name in ("predictor", "cross"):
            bits, data = args
            w.put(PREDICTOR if name == "predictor" else CROSS, 2)
            w.put(bits - 2, 3)
            data = (np.uint32(0xFF000000) | (data.astype(np.uint32) << 8 if name == "predictor" else data.astype(np.uint32))).astype(np.uint32)
            _write_image(w, data.ravel(), False)
            px = (_predictor if name == "predictor" else _cross)(px, data, bits, -1)
        else:
            colours, px = indexed(px)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            _write_image(w, joined(*[np.diff(c, prepend=0) for c in split_channels(colours)]), False)
    w.put(0, 1)
    _write_image(w, tokens or px.ravel(), True, cache_bits, matches, px.shape[1])
    data = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


class Reader:
    def __init__(self, data: bytes):
        self.data, self.pos = data + b"\0" * 8, 0

    def bits(self, n: int) -> int:
        if not n:
            return 0
        at, off = self.pos >> 3, self.pos & 7
        self.pos += n
        return int.from_bytes(self.data[at : at + 5], "little") >> off & ((1 << n) - 1)

    def peek(self, pos: int, n: int) -> int:
        return int.from_bytes(self.data[pos >> 3 : (pos + n + 7) >> 3], "little") >> (pos & 7) & ((1 << n) - 1)

    def symbol(self, table: tuple[list, int]) -> int:
        entries, n = table
        at = self.pos >> 3
        e = entries[int.from_bytes(self.data[at : at + 4], "little") >> (self.pos & 7) & ((1 << n) - 1)]
        self.pos += e & 15
        return e >> 4


@functools.lru_cache(maxsize=256)
def _own_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    table, n = table_of(np.array(lengths))
    return table.tolist(), n


def read_lengths(r: Reader, size: int) -> np.ndarray:
    """Code lengths of one prefix code; a symbol that stands nowhere has 0."""
    out = np.zeros(size, dtype=np.int64)
    if r.bits(1):
        two = r.bits(1)
        out[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            out[r.bits(8)] = 1
        return out
    own = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.bits(4)]:
        own[s] = r.bits(3)
    entries, n = _own_table(tuple(own))
    left = size
    if r.bits(1):
        left = 2 + r.bits(2 + 2 * r.bits(3))
    i, last, mask, pos, data, at, found, take = 0, 8, (1 << n) - 1, r.pos, r.data, [], [], int.from_bytes
    while i < size and left:
        left -= 1
        v = take(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7)
        e = entries[v & mask]
        v >>= e & 15
        pos += e & 15
        s = e >> 4
        if s < 16:
            if s:
                at.append(i)
                found.append(s)
                last = s
            i += 1
        elif s == 16:
            k = 3 + (v & 3)
            pos += 2
            at += range(i, min(size, i + k))
            found += [last] * (min(size, i + k) - i)
            i += k
        elif s == 17:
            i += 3 + (v & 7)
            pos += 3
        else:
            i += 11 + (v & 127)
            pos += 7
    r.pos = pos
    out[at] = found
    return out


def _read_tables(r: Reader, cache_bits: int) -> list[tuple[np.ndarray, int]]:
    """Decoding tables of one code group; a code told in the same bits as the one before is not read again."""
    out, bits, told = [], 0, -1
    for size in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40):
        if size == 256 and told >= 0 and r.peek(r.pos, bits) == told:
            r.pos += bits
            out.append(out[-1])
            continue
        start = r.pos
        out.append(table_of(read_lengths(r, size)))
        bits = r.pos - start
        told = r.peek(start, bits) if size == 256 else -1
    return out


def _read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    meta, meta_bits, groups_n = None, 0, 1
    if main and r.bits(1):
        meta_bits = 2 + r.bits(3)
        side = -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits))
        meta = (_read_image(r, *side, False) >> 8 & 0xFFFF).tolist()
        groups_n = max(map(max, meta)) + 1
    groups = [[(t.tolist(), n) for t, n in _read_tables(r, cache_bits)] for _ in range(groups_n)]
    return _pixels(r, width, height, groups, meta, meta_bits, cache_bits)


def _distance(d: int, width: int) -> int:
    """Pixels back that a distance code means."""
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def _pixels(r: Reader, width: int, height: int, groups: list, meta, meta_bits: int, cache_bits: int, out: list | None = None, cache: list | None = None, copy: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The scalar walk; ``out``, ``cache`` and ``copy`` (pixels left, distance) are what is known of an image that was begun."""
    total, out, cache = width * height, out or [], cache or [0] * (1 << cache_bits)
    data, pos, take, group, shift = r.data, r.pos, int.from_bytes, groups[0], 32 - cache_bits
    length, d = copy
    (tg, ng), (tr, nr), (tb, nb), (ta, na), _ = group
    while len(out) < total:
        i = len(out)
        if not length:
            if meta is not None:
                group = groups[meta[i // width >> meta_bits][i % width >> meta_bits]]
                (tg, ng), (tr, nr), (tb, nb), (ta, na), _ = group
            at = pos >> 3
            v = take(data[at : at + 9], "little") >> (pos & 7)  # four codes of at most 15 bits
            e = tg[v & ((1 << ng) - 1)]
            v >>= e & 15
            pos += e & 15
            s = e >> 4
            if s < 256:
                red = tr[v & ((1 << nr) - 1)]
                v >>= red & 15
                blue = tb[v & ((1 << nb) - 1)]
                v >>= blue & 15
                alpha = ta[v & ((1 << na) - 1)]
                pos += (red & 15) + (blue & 15) + (alpha & 15)
                out.append((alpha >> 4) << 24 | (red >> 4) << 16 | s << 8 | blue >> 4)
            elif s < 280:
                r.pos = pos
                length = _value(r, s - 256)
                d = _distance(_value(r, r.symbol(group[4])), width)
                pos = r.pos
                if d > i:
                    raise ValueError("a back-reference before the image")
            else:
                out.append(cache[s - 280])
        if length:
            length = min(length, total - i)
            if d >= length:
                out += out[i - d : i - d + length]
            else:  # a copy that reads what it writes: a pattern of d pixels
                out += (out[i - d :] * (length // d + 1))[:length]
            length = 0
        if cache_bits:
            for v in out[i:]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
    r.pos = pos
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def header(data: bytes) -> tuple[Reader, int, int, list]:
    """(reader at the main image, its width, height, transforms read)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = Reader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(4)
    transforms, w = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.bits(3) + 2
            transforms.append((kind, bits, _read_image(r, -(-w // (1 << bits)), -(-height // (1 << bits)), False)))
        elif kind == GREEN:
            transforms.append((kind, 0, None))
        else:
            n = r.bits(8) + 1
            colours = joined(*[np.cumsum(c) for c in split_channels(_read_image(r, n, 1, False).ravel())])
            full = w
            w, bits = packed_width(w, n)
            transforms.append((kind, (bits, full), colours))
    return r, w, height, transforms


def undo(px: np.ndarray, transforms: list) -> np.ndarray:
    """Inverts the transforms, the last first."""
    for kind, bits, data in reversed(transforms):
        if kind == PREDICTOR:
            px = _predictor(px, data, bits, 1)
        elif kind == CROSS:
            px = _cross(px, data, bits, 1)
        elif kind == GREEN:
            a, r, g, b = split_channels(px)
            px = joined(a, r + g, g, b + g)
        else:
            (bits, width), size = bits, 8 >> bits[0]
            g = (px >> 8 & 255).astype(np.int64)
            index = np.stack([g >> (k * size) & ((1 << size) - 1) for k in range(1 << bits)], axis=2).reshape(len(px), -1)[:, :width]
            colours = np.concatenate([data, np.zeros(256, dtype=np.uint32)])
            px = colours[index]
    return px


def decode(data: bytes) -> np.ndarray:
    r, w, h, transforms = header(data)
    return undo(_read_image(r, w, h, True), transforms)


def decode_many(files: list[bytes], few: int = 40) -> list[np.ndarray]:
    """Pixels of each file; images with one code group go in lockstep while more than ``few`` are open."""
    out: list = [None] * len(files)
    lanes = []
    for i, f in enumerate(files):
        r, w, h, transforms = header(f)
        start = r.pos
        cache_bits = r.bits(4) if r.bits(1) else 0
        if r.bits(1):
            r.pos = start
            out[i] = undo(_read_image(r, w, h, True), transforms)
        else:
            lanes.append((w * h, i, r, w, h, transforms, _read_tables(r, cache_bits), cache_bits))
    lanes.sort(key=lambda x: (-x[0], x[1]))
    for lane, px in zip(lanes, _lockstep(lanes, few), strict=True):
        out[lane[1]] = undo(px.reshape(lane[4], lane[3]), lane[5])
    return out


class _Streams:
    """The bits and tables of many images in flat arrays."""

    def __init__(self, lanes: list):
        self.starts = np.cumsum([0, *(len(x[2].data) for x in lanes[:-1])])
        raw = np.frombuffer(b"".join(x[2].data for x in lanes) + bytes(8), dtype=np.uint8).astype(np.uint32)
        self.window = raw.copy()  # 32 bits at every byte
        for k in (1, 2, 3):
            self.window[:-k] |= raw[k:] << np.uint32(8 * k)
        self.pos = self.starts * 8 + np.array([x[2].pos for x in lanes])
        tables = [[x[6][k] for x in lanes] for k in range(5)]
        sizes = np.array([[len(t) for t, _ in own] for own in tables])
        self.base = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        self.mask = np.array([[(1 << n) - 1 for _, n in own] for own in tables], dtype=np.uint32)
        self.flat = np.concatenate([t for own in tables for t, _ in own]).astype(np.int32)

    def read(self, k: int, at, p):
        """Entry of code ``k`` of images ``at`` at bits ``p``."""
        return self.flat[self.base[k][at] + ((self.window[p >> 3] >> (p & 7).astype(np.uint32)) & self.mask[k][at])]

    def value(self, prefix: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Lengths or distances that prefixes and the bits after them mean; ``p`` moves on."""
        extra = np.maximum(0, (prefix - 2) >> 1)
        bits = (self.window[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << extra) - 1)
        p += extra
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + bits) + 1


def _lockstep(lanes: list, few: int) -> list[np.ndarray]:
    """Flat pixels of the lanes, which come longest first."""
    if not lanes:
        return []
    sizes, widths, st = np.array([x[0] for x in lanes]), np.array([x[3] for x in lanes]), _Streams(lanes)
    first = np.cumsum(sizes) - sizes
    px = np.zeros(int(sizes.sum()), dtype=np.uint32)
    near = np.array([(0, 0), *NEAR])
    cached = np.array([x[7] for x in lanes])
    room = np.where(cached > 0, 1 << cached, 0)
    cache, cache_at, shift = np.zeros(int(room.sum()) + 1, dtype=np.uint32), np.cumsum(room) - room, (32 - cached).astype(np.uint32)
    left, far = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    alone = [bool((m == 0).all()) for m in st.mask[:4]]
    done = 0
    while done < sizes[0]:
        n = int(np.searchsorted(-sizes, -done, side="left"))
        if n <= few:
            break
        steps, own = int(sizes[n - 1] - done), slice(0, n)
        p, copying, at, holds = st.pos[:n].copy(), left[:n], first[:n], np.flatnonzero(cached[:n])
        fixed, live = np.zeros(n, dtype=np.uint32), []
        for k, s in ((1, 16), (2, 0), (3, 24)):
            if alone[k]:
                fixed |= (st.flat[st.base[k][own]] >> 4).astype(np.uint32) << np.uint32(s)
            else:
                live.append((k, np.uint32(s)))
        busy = bool(copying.any())
        for step in range(done, done + steps):
            e = st.read(0, own, p)
            symbol = e >> 4
            odd = np.flatnonzero((symbol > 255) | (copying > 0) if busy else symbol > 255)
            before, row = p[odd], fixed | symbol.astype(np.uint32) << np.uint32(8)
            p += e & 15
            for k, s in live:
                e = st.read(k, own, p)
                p += e & 15
                row |= (e >> 4).astype(np.uint32) << s
            if len(odd):  # not a literal: the bits after green were not the pixel's
                new = copying[odd] == 0
                p[odd] = before
                fresh, s = odd[new], symbol[odd[new]]
                q = p[fresh] + (st.read(0, fresh, p[fresh]) & 15)
                hit = s >= 280
                row[fresh[hit]] = cache[cache_at[fresh[hit]] + s[hit] - 280]
                ref = fresh[~hit]
                if len(ref):
                    b = q[~hit]
                    copying[ref] = st.value(s[~hit].astype(np.int64) - 256, b)
                    e = st.read(4, ref, b)
                    b += e & 15
                    d = st.value((e >> 4).astype(np.int64), b)
                    x, y = near[np.minimum(d, 120)].T
                    far[ref] = np.where(d > 120, d - 120, np.maximum(1, x + y * widths[ref]))
                    if (far[ref] > step).any():
                        raise ValueError("a back-reference before the image")
                    q[~hit] = b
                p[fresh] = q
                repeat = odd[copying[odd] > 0]
                row[repeat] = px[at[repeat] + step - far[repeat]]
                copying[repeat] -= 1
                busy = bool((copying[repeat] > 0).any())
            else:
                busy = False
            px[at + step] = row
            if len(holds):
                v = row[holds]
                cache[cache_at[holds] + ((v * np.uint32(CACHE_FACTOR)) >> shift[holds])] = v
        st.pos[:n] = p
        done += steps
    out = [px[a : a + n] for a, n in zip(first, sizes, strict=True)]
    for i in range(len(lanes)):
        if done >= sizes[i]:
            break
        _, _, r, w, h, _, tables, bits = lanes[i]
        r.pos = int(st.pos[i] - st.starts[i] * 8)
        held = cache[cache_at[i] : cache_at[i] + (1 << bits)].tolist() if bits else None
        out[i] = _pixels(r, w, h, [[(t.tolist(), n) for t, n in tables]], None, 0, bits, out[i][:done].tolist(), held, (int(left[i]), int(far[i]))).ravel()
    return out
