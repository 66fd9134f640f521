"""Exact Jaccard join of documents on word shingles, as a join in the metric space of Jaccard distance.

Two documents link when ``100 * |A and B| >= percent * |A or B|``: distance at most ``r = 1 - percent / 100``. What is returned is the class
of each document under links, so a region whose documents are known to be connected needs no further comparison.

1. Equal sets collapse into one class (a 128-bit hash of the set), so a text with a third of all rows is one row from here on.
2. *Regions.* Shells by set size come first, with windows: a set whose smaller partners may lie below its shell is replicated into
   the next lower one. In a shell the universe of shingles is dealt into parts; a part is a space of its own, in which each distinct
   small set is a pivot and a document falls to the pivot at distance 0. A linked pair differs in at most ``D = |A| (1 - t) / t``
   shingles (``t = percent / 100``), so it agrees in all parts but ``D``. Under any one order of all pivots, the first they share is among the first
   ``D + 1`` of each, so those regions suffice. A set enters some more than that, for then it has to share several with a partner, and sets that share too few
   with all others together drop out. The order puts frequent pivots last (passages that many documents share; a bounded list of them is
   counted first, over all texts) and larger ones first, so a document goes to regions that few unlinked documents enter. Sets with too
   few parts for a sure meeting add single shingles the same way.
3. *Region join.* A region's pivot is its most central class. Each class is first measured against the most central pivot it meets, unless parities
   of classes of shingles, which bound distances from below, rule a link out; true distances to the pivot are measured in regions that need them. If documents stay apart, the triangle inequality decides who goes on: all outside the pivot's component, and
   of those inside only the boundary, whose distance to the pivot is within ``r`` of an outsider's. They form the next region, with a pivot from
   outside, and join in turn, as long as a region has more members than a block. What is left is compared in blocks bounded by rows and bytes, each set of
   members once: first by those parities, then by the sets of those that stay, a range of shingle hashes at a time.

Sampled documents as pivots of the whole table are not used: unrelated texts are at distance near 1 from each other, so with windows of
``2 r`` nearly each falls to every pivot (the README has figures). Inside regions distances differ and the windows cut.

No step gathers a region in a task, emits all its pairs, or brings ids to the driver. Joins on regions are salted for the listed frequent pivots;
other joins Spark can split where a key is hot. Intermediate tables lie in the shared folder and go when nothing reads them any more.

Defined cases: without words or text a set is empty, links with nothing and is its own class (its own id); with fewer than ``n`` words the whole
sequence is one shingle; repeated rows are equal documents; ties between members go to the smallest id; a null id is never a class's id unless all its
members' are null; a text of any length is one set, which a task holds whole (8 bytes a word) when it is read or compared; an empty table gives no rows;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, release, slices, workspace, written

U = np.uint64
# Odd multipliers and shifts of a well-known 64-bit finaliser, and salts of our own.
MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
STEP, SALT_A, SALT_B, SALT_PART, SALT_ONE = U(0x9E3779B97F4A7C15), U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xB492B66FBE98F273)


def salt(k: int, by: np.uint64) -> np.uint64:
    return U(k * int(by) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * MIX[0]
    x = x ^ (x >> U(33))
    x = x * MIX[1]
    return x ^ (x >> U(33))


NONE = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
#: Bytes of text hashed at once, and of the longest word that is hashed with the others.
WINDOW, LONG = 1 << 15, 64
#: A-Z lower-cased, white space as spaces.
PLAIN = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(WINDOW - 1, U(base))]))


BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse
POWER, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _window(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of at most ``WINDOW`` bytes with a space at both ends.

    A hash is a difference of prefix sums of letters times powers, moved to the word's start.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    blank = b == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.cumsum(LETTER[b] * POWER[: len(b)])
    size = end - start
    h = mix((sums[end - 1] - sums[start - 1]) * INVERSE[start] + size.astype(np.uint64) * STEP)
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h, start


def _long(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, a window at a time."""
    out, at, most = [NONE[0]], 0, WINDOW - 2
    while at < len(data):
        end = len(data) if len(data) - at <= most else data.rfind(b" ", at, at + most) + 1
        if end <= at:  # one word fills the window
            end = data.find(b" ", at)
            end = len(data) if end < 0 else end
            out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], dtype=np.uint64))
        else:
            out.append(_window(b" %b " % data[at:end])[0])
        at = end
    return np.concatenate(out)


def word_hashes(texts: list[str | None]):
    """(hashes of the words of some texts in order, how many each has), for groups of texts; A-Z lower-cased, words split at ASCII white space."""
    group, held = [], 2
    for t in texts:
        data = t.encode().translate(PLAIN) if t else b""
        if group and held + len(data) + 1 > WINDOW:
            yield _group(group)
            group, held = [], 2
        if len(data) + 2 > WINDOW:
            h = _long(data)
            yield h, [len(h)]
            continue
        group.append(data)
        held += len(data) + 1
    if group:
        yield _group(group)


def _group(group: list[bytes]) -> tuple[np.ndarray, list[int]]:
    h, start = _window(b" %b " % b" ".join(group))
    ends = np.cumsum([len(d) + 1 for d in group]) + 1
    return h, np.diff(np.searchsorted(start, ends), prepend=0).tolist()


def _rolled(w: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(w) - k + 1, salt(k, SALT_B))
    for i in range(k):
        h = (h + w[i : len(w) - k + 1 + i]) * STEP
        h ^= h >> U(29)
    return mix(h)


def shingles(texts: list[str | None], n: int):
    """Sorted 64-bit hashes of the distinct shingles of ``n`` words of each text."""
    for w, counts in word_hashes(texts):
        rolled, at = _rolled(w, n) if len(w) >= n else NONE[0], 0
        for words in counts:
            h = rolled[at : at + words - n + 1] if words >= n else _rolled(w[at : at + words], words) if words else NONE[0]
            at += words
            h = np.sort(h)
            yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def set_hash(h: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    return b"".join(int(mix(h ^ s).sum(dtype=np.uint64)).to_bytes(8, "little") for s in (SALT_A, SALT_B))


def differing(n: int, percent: int) -> int:
    """The most shingles in which a set of ``n`` and a partner differ."""
    return n * (100 - percent) // percent


def _spaces(h: np.ndarray, percent: int):
    """(pivots, their sizes, how many of them partners share at least if the set enters that many regions beyond ``D``) of a set in each space it
    has to enter; singles come with size 0. The number depends on the shell alone, as long as the set has more pivots than ``D``.
    """
    n = len(h)
    d = differing(n, percent)
    if d == 0:  # links with equal sets only
        return
    shell = n.bit_length() - 1
    shells = [shell]
    if -(-n * percent // 100) < 1 << shell:
        shells.append(shell - 1)
    sums, high = np.concatenate([[U(0)], np.cumsum(mix(h ^ SALT_PART))]), h >> U(32)
    for s in shells:
        parts_n = int((1 << s) * (100 - percent) / (0.28 * percent)) + 1
        part = high * U(parts_n) >> U(32)  # hashes are sorted, and so are their parts
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [n]])
        first, end = first[:-1], first[1:]
        yield mix(sums[end] - sums[first] + part[first] * STEP + salt(s, SALT_A)), end - first, max(1, min(1 + differing(1 << s, percent) // 8, len(first) - d))
        if len(first) <= d:  # too few parts for a sure meeting
            yield mix(h ^ SALT_ONE ^ salt(s, SALT_B)), np.zeros(n, dtype=np.int64), 1


def region_tokens(h: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray] = NONE) -> list[tuple[int, np.ndarray]]:
    """(least shared, hashes of regions) of a set in each space. ``frequent``: pivots in order, and how often each occurs.

    A set enters ``D`` and some more regions, so that it shares not one but ``least`` of them with each partner it has in that space.
    """
    d, (known, times), out = differing(len(h), percent), frequent, []
    for token, size, least in _spaces(h, percent):
        often = np.zeros(len(token), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, token), len(known) - 1)
            often = np.where(known[at] == token, times[at], 0)
        out.append((least, token[np.lexsort((token, (often << 20) - size))[: d + least]]))
    return out


#: Bounds of the list of frequent pivots: entries in all, entries out of a task, pivots held while a task counts.
FREQUENT, FROM_TASK, COUNTED = 1 << 15, 1 << 13, 1 << 18
#: A pivot in fewer documents is not frequent.
OFTEN = 64


class Counter:
    """Counts pivots in bounded memory: those seen least go when it is full, so counts may fall short."""

    def __init__(self):
        self.known, self.times, self.new, self.held = *NONE, [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.new.append(tokens)
        self.held += len(tokens)
        if self.held > 4 * COUNTED:
            self.merge()

    def merge(self) -> None:
        tokens, n = np.unique(np.concatenate([NONE[0], *self.new]), return_counts=True)
        keep = n > 1 if len(tokens) > COUNTED else n > 0
        both, at = np.unique(np.concatenate([self.known, tokens[keep]]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([self.times, n[keep]]), minlength=len(both)).astype(np.int64)
        if len(both) > COUNTED:
            order = np.sort(np.argpartition(-times, COUNTED)[:COUNTED])
            both, times = both[order], times[order]
        self.known, self.times, self.new, self.held = both, times, [], 0

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        own = np.argsort(-self.times, kind="stable")[:FROM_TASK]
        own = own[self.times[own] > 2]
        return self.known[own], self.times[own]


def frequent_pivots(df: DataFrame, n: int, percent: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pivots of all texts, in order, and their counts: a list of bounded length that only steers the order of pivots."""
    kind = T.StructType([T.StructField("token", T.LongType()), T.StructField("times", T.LongType())])

    def run(batches):
        found, met = Counter(), set()
        for b in slices(batches, rows):
            if len(met) >= 50_000:
                met.clear()
            own = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            texts = [t for key, t in own.items() if key not in met]  # copies count once, as far as memory of them goes
            met.update(own)
            for h in shingles(texts, n):
                for token, *_ in _spaces(h, percent):
                    found.add(token)
        token, times = found.most()
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], names=kind.names)

    sums = df.select("text_hash", "text").mapInArrow(run, kind).groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    t = sums.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    token = t.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], t.column("times").to_numpy()[order]


SPACE = T.StructType([T.StructField("least", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])


def _sets(df: DataFrame, n: int, percent: int, frequent, rows: int) -> DataFrame:
    """(id, text_hash, n, set_hash, spaces): of each space of a set, the regions it enters and how many of them it shares with a partner at least."""
    kind = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("text_hash", T.StringType()), T.StructField("n", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("spaces", T.ArrayType(SPACE))])
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT pairs of numbers

    def run(batches):
        known = shared.value
        for b in slices(batches, rows):
            sizes, keys, spaces = [], [], []
            for h in shingles(b.column(2).to_pylist(), n):
                sizes.append(len(h))
                keys.append(set_hash(h))
                spaces.append(region_tokens(h, percent, known))
            flat = [space for own in spaces for space in own]
            ends = pa.array(np.cumsum([0, *(len(t) for _, t in flat)]), pa.int32())
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([NONE[0], *(t for _, t in flat)]).view(np.int64)))
            structs = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.int32()), tokens], names=SPACE.names)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spaces)]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], names=kind.names)

    return df.select("id", "text_hash", "text").mapInArrow(run, kind)


def _bodies(df: DataFrame, n: int, rows: int) -> DataFrame:
    """(c, body): the sorted shingle hashes of the texts of classes."""
    kind = T.StructType([T.StructField("c", T.LongType()), T.StructField("body", T.BinaryType())])

    def run(batches):
        for b in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in shingles(b.column(1).to_pylist(), n)], pa.binary())], names=kind.names)

    return df.select("c", "text").mapInArrow(run, kind)


#: Bits of the largest filter of needed texts; its words are at most a 64th as many rows.
FILTER_BITS = 1 << 25


def maybe_needed(texts: DataFrame, need: DataFrame) -> DataFrame:
    """Rows of ``texts`` (id, text_hash, text) but for most that ``need`` (_hash) lacks, by a bit table of bounded size: they stay out of the shuffle."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * need.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(at(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(c), F.lit(64)).cast("int"))
    table = need.groupBy(word("_hash").alias("_word")).agg(F.bit_or(bit("_hash")).alias("_bits"))
    # Broadcast: at most FILTER_BITS / 64 rows of two numbers.
    return texts.join(F.broadcast(table), (word("text_hash") == F.col("_word")) & (F.col("_bits").bitwiseAND(bit("text_hash")) != 0)).select(*texts.columns)


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two packed sets."""
    read = lambda x: np.frombuffer(x, dtype=np.uint64)
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = read(x), read(y)
        if not len(x) or not len(y):
            out.append(0)
            continue
        if len(x) > len(y):
            x, y = y, x
        out.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
    return pd.Series(out, dtype="int64")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(c, root): the smallest class that each class of ``edges`` (a, b) is connected with, by alternating star contractions."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/edges-0")
    i = 0
    while not _stars(edges):
        i += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Each a now leads to smaller ones only: tie a and all of them to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), f"{folder}/edges-{i}")
    return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each class has one edge and no root has any."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


#: At most so many spaces does a set enter: two shells, each with parts and singles.
SPACES = 4

#: Parts of a frequent pivot's region in joins.
SALTS = 64


class Salted:
    """Joins and sums by region in which the regions of frequent pivots are dealt in parts."""

    def __init__(self, spark: SparkSession, frequent: tuple[np.ndarray, np.ndarray]):
        # Broadcast below: at most FREQUENT rows.
        self.hot = spark.createDataFrame(pa.table({"token": frequent[0].view(np.int64), "_hot": pa.array([True] * len(frequent[0]), pa.bool_())}).to_pandas(), "token long, _hot boolean")

    def rows(self, rows: DataFrame) -> DataFrame:
        """``rows`` (token, c, ...) with _salt."""
        x = rows.join(F.broadcast(self.hot), "token", "left")
        return x.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("c"), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")

    def each(self, table: DataFrame) -> DataFrame:
        """``table`` (token, ...), once for each salt of its region."""
        x = table.join(F.broadcast(self.hot), "token", "left")
        return x.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")

    def join(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` (token, c, ...) with what ``table``, of one row for each region, says."""
        return self.rows(rows).join(self.each(table), ["token", "_salt"], how).drop("_salt")

    def one_token_each(self, rows: DataFrame, path: str) -> DataFrame:
        """``rows`` (token, c, ...) of regions with two members at least, one region for each set of members, with ``k`` members and ``m`` such regions.

        The rows are shuffled once: sums within a salt, and the join back, use the same exchange.
        """
        dealt = self.rows(rows).repartition("token", "_salt")
        part = dealt.groupBy("token", "_salt").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.sum(F.hash("c").cast("long")).alias("y"))
        cold = part.join(F.broadcast(self.hot), "token", "left_anti").where("k > 1").select("token", "k", "x", "y")
        hot = part.join(F.broadcast(self.hot), "token", "left_semi").groupBy("token").agg(F.sum("k").alias("k"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("k > 1")
        kept = cold.unionAll(hot).groupBy("k", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("m")).select("token", "k", "m")
        return written(dealt.join(self.each(kept), ["token", "_salt"]).drop("_salt"), path)


class Regions:
    """The region join over one table of classes."""

    def __init__(self, bodies: DataFrame, percent: int, folder: str, salted: Salted):
        self.bodies, self.percent, self.folder, self.salted = bodies, percent, folder, salted
        self.labels: DataFrame | None = None
        self.made = 0
        self.parities = written(bodies.select("c", parities(percent)("body").alias("body")), self._next("parities"))

    def _next(self, name: str) -> str:
        self.made += 1
        return f"{self.folder}/{name}-{self.made}"

    def sifted(self, pairs: DataFrame) -> DataFrame:
        """(c, p, near) of distinct pairs: whether parities allow a link."""
        near = pairs_may_link(self.percent)("body", "body_p").alias("near")
        x = pairs.join(self.parities, "c").join(self.parities.select(F.col("c").alias("p"), F.col("body").alias("body_p")), "p").select("c", "p", near)
        return written(x, self._next("sifted"))

    def measure(self, pairs: DataFrame) -> DataFrame:
        """(c, p, d, link) of distinct pairs."""
        body = self.bodies
        x = pairs.join(body, "c").join(body.select(F.col("c").alias("p"), F.col("body").alias("body_p")), "p")
        x = x.select("c", "p", common("body", "body_p").alias("met"), (F.octet_length("body") / 8).cast("long").alias("n_c"), (F.octet_length("body_p") / 8).cast("long").alias("n_p"))
        x = x.select("c", "p", (1 - F.col("met") / (F.col("n_c") + F.col("n_p") - F.col("met"))).alias("d"), F.expr(f"100 * met >= {self.percent} * (n_c + n_p - met)").alias("link"))
        out = written(x, self._next("known"))
        self._add(out.where("link").select(F.col("c").alias("a"), F.col("p").alias("b")))
        return out

    def _add(self, links: DataFrame) -> None:
        """Merges new links into the components so far, whose stars stand for all earlier links."""
        old = self.labels
        edges = links if old is None else links.unionAll(old.select(F.col("c").alias("a"), F.col("root").alias("b")))
        self.labels = components(edges, self._next("components"))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (token, c, p) with the components of c and p."""
        x = rows.join(self.labels.withColumnRenamed("root", "lc"), "c", "left").join(self.labels.select(F.col("c").alias("p"), F.col("root").alias("lp")), "p", "left")
        return x.withColumns({"lc": F.coalesce("lc", "c"), "lp": F.coalesce("lp", "p")})

    def apart(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the regions that hold more than one component, with ``k`` rows of the region."""
        x = written(self.labelled(rows), self._next("labelled"))
        parts = self.salted.rows(x).groupBy("token", "_salt").agg(F.count("*").alias("k"), F.max(F.col("lc") != F.col("lp")).alias("split"))
        split = parts.groupBy("token").agg(F.sum("k").alias("k"), F.max("split").alias("split")).where("split").select("token", "k")
        return written(self.salted.join(x, split), self._next("rows"))

    def join(self, rows: DataFrame, rounds: int, block: int) -> DataFrame:
        """Settles regions (token, c, p, rank) and returns (c, root)."""
        # First each class with the most central pivot it meets: in groups of copies this connects nearly all.
        central = self.sifted(rows.groupBy("c").agg(F.max_by("p", "rank").alias("p")))
        measured = self.measure(central.where("near").select("c", "p")).select("c", "p", "d")
        never = central.where("not near").select("c", "p")  # no link, at a distance that was not measured
        rows = self.apart(rows.select("token", "c", "p"))
        small = rows.where(F.col("k") <= block)
        for _ in range(rounds):
            large = rows.where(F.col("k") > block)
            if large.isEmpty():
                rows = large
                break
            missing = large.select("c", "p").distinct().join(measured.select("c", "p"), ["c", "p"], "left_anti")
            measured = measured.unionAll(self.measure(missing).select("c", "p", "d"))
            # Who goes on: outsiders, and insiders at the boundary of the pivot's component.
            x = written(self.labelled(large.select("token", "c", "p").join(measured, ["c", "p"])), self._next("measured"))
            r = 1 - self.percent / 100 + 1e-9
            ends = x.where("lc <> lp").groupBy("token").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min("c").alias("q"))
            x = self.salted.join(x, ends).where(f"c <> q and (lc <> lp or d between low - {r} and high + {r})")
            rows = self.apart(x.select("token", "c", F.col("q").alias("p")))
            small = small.unionAll(rows.where(F.col("k") <= block))
        # Two members that were measured already have nothing left to compare.
        known = measured.select("c", "p").unionAll(never)
        small = small.join(known.select("c", "p", F.lit(1).cast("long").alias("k")), ["c", "p", "k"], "left_anti").select(*small.columns)
        # Written, as it is read twice: its plan spans all rounds.
        rest = written(small.unionAll(rows.where(F.col("k") > block)), self._next("rest"))
        if not rest.isEmpty():
            self._blocks(rest, block)
        return self.labels

    def _blocks(self, rows: DataFrame, block: int) -> None:
        """Compares the classes of each region that are in different components, two blocks at a time.

        First by parities, which bound a difference from below: who can have no partner goes.
        """
        members = rows.select("token", "c", F.col("lc").alias("label")).unionAll(rows.select("token", F.col("p").alias("c"), F.col("lp").alias("label")).distinct())
        members = self.salted.one_token_each(members, self._next("members"))
        percent = self.percent
        near = self._pairs_of_blocks(members, self.parities, block)
        some = grouped(near, lambda t: t.filter(pa.array(has_partner(t, percent))), near.schema).select("token", "c", "label").distinct()
        some = written(some, self._next("some"))

        def compare(t: pa.Table) -> pa.Table:
            edges = linked_pairs([np.frombuffer(b, dtype=np.uint64) for b in t.column("body").to_pylist()], t.column("label").to_numpy(), percent)
            ids = t.column("c").to_numpy()
            return pa.table({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

        kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
        found = grouped(self._pairs_of_blocks(some, self.bodies, block), compare, kind).distinct()
        self._add(written(found, self._next("found")))

    def _pairs_of_blocks(self, members: DataFrame, bodies: DataFrame, block: int, block_bytes: int = 4 << 20) -> DataFrame:
        """``members`` with bodies, dealt to pairs (i, j) of blocks of their region: about ``block`` rows and ``block_bytes`` each."""
        size = bodies.select("c", F.octet_length("body").cast("long").alias("_size"))
        sized = members.select("token", "c", "label").join(size, "c")
        counts = self.salted.rows(sized).groupBy("token", "_salt").agg(F.count("*").alias("k"), F.sum("_size").alias("s")).groupBy("token").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
        blocks = F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("s") / block_bytes)).cast("int")
        x = self.salted.join(members.select("token", "c", "label"), counts.where("k > 1").select("token", blocks.alias("blocks"))).withColumn("own", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return x.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "label").join(bodies, "c")


def grouped(df: DataFrame, f, kind: T.StructType) -> DataFrame:
    """``f`` of the Arrow table of each (token, i, j): many small groups go through one task's stream, one at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in slices(batches, 2048):
            keys = np.stack([b.column(b.schema.get_field_index(n)).to_numpy().astype(np.int64) for n in ("token", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if first == end:
                    continue
                own = tuple(keys[:, first].tolist())
                if held and own != last:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(b.slice(first, end - first))
                last = own
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return df.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, kind)


def parity(h: np.ndarray, percent: int) -> np.ndarray:
    """The size of a set, and whether each class of its shingles (by their low bits) holds an odd number, 64 classes a word.

    Two sets differ in as many shingles at least as in odd classes. There are four times as many classes as shingles in which a set and a partner of
    its size may differ, so sets that differ by much more are told apart; as a power of two, so halves fold into the vector of a set of fewer classes.
    """
    bits = 1 << max(9, (8 * len(h) * (100 - percent) // (100 + percent)).bit_length())
    odd = np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.concatenate([[U(len(h))], np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)])


def parities(percent: int):
    @F.pandas_udf(T.BinaryType())
    def of(body: pd.Series) -> pd.Series:
        return pd.Series([parity(np.frombuffer(b, dtype=np.uint64), percent).tobytes() for b in body], dtype=object)

    return of


def folded(odd: np.ndarray) -> np.ndarray:
    """The parities in half as many classes."""
    return odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]


def may_link(x: list[np.ndarray], labels: np.ndarray, percent: int):
    """(i, js): for some sets, by their parities, the sets of other labels that they may link with; each pair once.

    A partner has at most twice the classes, as its size is less than twice the set's.
    """
    size, words = np.array([int(p[0]) for p in x], dtype=np.int64), np.array([len(p) - 1 for p in x])
    for width in np.unique(words).tolist():
        own, wide = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        all_, odd = np.concatenate([own, wide]), np.stack([*(x[i][1:] for i in own), *(folded(x[i][1:]) for i in wide)])
        for k, i in enumerate(own.tolist()):
            js = all_[k + 1 :]
            at = k + 1 + np.flatnonzero((labels[js] != labels[i]) & (100 * np.minimum(size[i], size[js]) >= percent * np.maximum(size[i], size[js])))
            differ = np.bitwise_count(odd[at] ^ odd[k]).sum(axis=1, dtype=np.int64)
            js = all_[at]
            yield i, js[(100 + percent) * differ <= (100 - percent) * (size[i] + size[js])]


def pairs_may_link(percent: int):
    @F.pandas_udf(T.BooleanType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: np.frombuffer(x, dtype=np.uint64)
        two = np.arange(2)
        return pd.Series([any(len(js) for _, js in may_link([read(x), read(y)], two, percent)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return of


def has_partner(t: pa.Table, percent: int) -> np.ndarray:
    """Whether the parities of a row allow a link with some row of another label."""
    x, out = [np.frombuffer(b, dtype=np.uint64) for b in t.column("body").to_pylist()], np.zeros(len(t), dtype=bool)
    for i, js in may_link(x, t.column("label").to_numpy(), percent):
        out[js] = True
        out[i] |= len(js) > 0
    return out


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, percent: int, cells: int = 1 << 21, values: int = 1 << 19) -> np.ndarray:
    """Links (i, j) that connect different labels, a spanning forest of them.

    Intersections come from products of incidence matrices: about ``values`` shingles of a range of hashes at a time, some columns at a
    time, so that memory beyond the sets themselves is bounded.
    """
    g, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    met, wide = np.zeros((g, g)), max(1, cells // g)
    ranges = max(1, -(-int(size.sum()) // values))
    limits = [U(k * (1 << 64) // ranges) for k in range(1, ranges)]
    ends = np.stack([np.concatenate([[0], np.searchsorted(s, limits), [len(s)]]) if ranges > 1 else np.array([0, len(s)]) for s in sets]).astype(np.int64)
    for k in range(ranges):
        some = [s[e[k] : e[k + 1]] for s, e in zip(sets, ends, strict=True)]
        _, column, times = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        owner, keep = np.repeat(np.arange(g), ends[:, k + 1] - ends[:, k]), times > 1  # a shingle of one set meets none
        dense = (np.cumsum(keep) - 1)[column]
        owner, dense = owner[keep[column]], dense[keep[column]]
        order = np.argsort(dense, kind="stable")
        owner, dense = owner[order], dense[order]
        for first in range(0, int(keep.sum()), wide):
            a, b = np.searchsorted(dense, (first, first + wide))
            m = np.zeros((g, wide), dtype=np.float32)
            m[owner[a:b], dense[a:b] - first] = 1
            met += m @ m.T
    link = (100 * met >= percent * (size[:, None] + size[None, :] - met)) & (labels[:, None] != labels[None, :])
    root, out = {}, []

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, j in np.argwhere(np.triu(link)).tolist():
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            root[x] = y
            out.append((i, j))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _classes(df: DataFrame, n: int, percent: int, doc_id: str, text: str, rounds: int, block: int, rows: int) -> DataFrame:
    """(id, text_hash, n, root) of each row; the rows of a class, and they alone, have its root."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = df.sparkSession
    folder = workspace(spark, "jaccard")
    base = df.select(F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    frequent = frequent_pivots(base, n, percent, rows)
    salted = Salted(spark, frequent)
    sets = written(_sets(base, n, percent, frequent, rows).withColumn("row", F.monotonically_increasing_id()), f"{folder}/sets")
    owner = sets.where("n > 0").groupBy("set_hash").agg(F.min("row").alias("c"))
    whole = sets.select("row", "id", "n", "set_hash", "text_hash").where("n > 0").join(owner, "set_hash").drop("set_hash")
    empty = sets.where("n = 0").select("row", "id", "n", "text_hash", F.col("row").alias("c"))
    members = written(whole.unionByName(empty), f"{folder}/members")
    first = members.where("row = c and n > 0").select("c", "id", "text_hash")
    # A class in one of its (at most SPACES) spaces: c * SPACES + space.
    spaces = sets.select(F.col("row").alias("c"), "spaces").where(F.size("spaces") > 0).join(first.select("c"), "c", "left_semi").select("c", F.posexplode("spaces").alias("at", "space"))
    spaces = spaces.select((F.col("c") * SPACES + F.col("at")).alias("c"), "space.least", "space.tokens")
    met = salted.one_token_each(spaces.select(F.explode("tokens").alias("token"), "c"), f"{folder}/met")
    # Who shares too few regions with all others together has no partner in that space.
    enough = met.groupBy("c").agg(F.sum("m").alias("shared")).join(spaces.select("c", "least"), "c").where("shared >= least").select("c")
    shared = salted.one_token_each(met.join(enough, "c", "left_semi").select("token", F.expr(f"c div {SPACES}").alias("c")).distinct(), f"{folder}/shared")
    release(spark, f"{folder}/sets", f"{folder}/met")
    # The pivot of a region is its most central class: the one whose regions hold the most classes; a hash breaks ties.
    central = shared.groupBy("c").agg(F.sum("k").alias("s")).withColumn("rank", F.shiftleft("s", 20) + F.pmod(F.xxhash64("c"), F.lit(1 << 20)))
    ranked = shared.select("token", "c").join(central.select("c", "rank"), "c")
    pivots = ranked.groupBy("token").agg(F.max_by("c", "rank").alias("p"), F.max("rank").alias("rank"))
    regions = written(salted.join(shared.select("token", "c"), pivots).where("c <> p"), f"{folder}/regions")
    release(spark, f"{folder}/shared")
    # Shingles of the classes that share a region, from their texts.
    met = regions.select("c").unionAll(regions.select(F.col("p").alias("c"))).distinct()
    need = written(first.join(met, "c", "left_semi").select("c", F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), f"{folder}/need")
    texts = maybe_needed(base, need).join(need, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("c", "text")
    bodies = written(_bodies(texts, n, rows).dropDuplicates(["c"]), f"{folder}/bodies")
    labels = written(Regions(bodies, percent, f"{folder}/join", salted).join(regions, rounds, block), f"{folder}/labels")
    release(spark, *(f"{folder}/{x}" for x in ("regions", "need", "bodies", "join")))
    return members.join(labels, "c", "left").select("id", "text_hash", "n", F.coalesce("root", "c").alias("root"))


def classes(df: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, block: int = 512, rows: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: its set's size, and the smallest id that links reach."""
    named = _classes(df, n, percent, doc_id, text, rounds, block, rows)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


#: Rows of the largest list of dropped documents that is broadcast, at two numbers a row.
BROADCAST_ROWS = 1 << 20


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the first of its class, by id and then by a hash of the text; rows without an id stay.

    Rows that repeat both id and text stay once. Ids may repeat with other texts: each such row is a document of its own.
    """
    spark, folder = df.sparkSession, workspace(df.sparkSession, "jaccard-kept")
    named = _classes(df, n, percent, doc_id, text, 3, 512, 512).where("id is not null")
    texts = named.groupBy("root", "id", "text_hash").agg(F.count("*").alias("times"))
    first = texts.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    judged = texts.join(first, "root").withColumn("kept", F.struct("id", "text_hash") == F.col("first"))
    id_, key_, kept_ = (free_name(x, df.columns) for x in ("_id", "_key", "_kept"))
    judged = judged.where("not kept or times > 1").select(F.col("id").alias(id_), F.xxhash64("text_hash").alias(key_), F.col("kept").alias(kept_))
    judged = written(judged, f"{folder}/judged")
    own = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(F.md5(F.coalesce(F.col(text), F.lit("")))) == F.col(key_))
    kept = judged.where(kept_)
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_ROWS else judged
    out = df.join(judged, own, "left_anti")
    if kept.isEmpty():
        return out
    mark = free_name("_text", df.columns)
    again = df.join(kept, own, "left_semi").withColumn(mark, F.md5(F.coalesce(F.col(text), F.lit(""))))
    return out.unionAll(again.dropDuplicates([doc_id, mark]).drop(mark))
