"""Nearest neighbours by a hash-prefix forest.

Distinct vectors are dealt into blocks of bounded size by a hash; each block has a forest of its own, built once and written to the shared
folder, so every row is indexed, hashed once, and recall doesn't depend on how many blocks there are. The signs of a vector against a pool of
fixed hyperplanes are its bits; a tree is a permutation of them, which gives each vector a string of 64 bits, and the sorted array of these
strings. A query is hashed once too. It descends in all trees to prefixes so long that fewer than ``share`` of the block's vectors (and never
fewer than ``least``) match in all trees together; how long they are varies from query to query. Then it ascends in all trees at once, one bit at
a time, and within a bit some trees at a time, until enough distinct vectors are candidates. Candidates are ranked by exact cosine in double
precision; the best of all blocks are merged.

Queries (a stated set against all rows) go to the index in chunks of bounded size, each broadcast to a scan of the index: neither rows nor
queries are copied for each other, and what is shuffled is ``k`` results of each query and block. Vectors of different lengths are never compared.

Why a share: in these data the five nearest of 64 dimensions are at a cosine of about 0.45, hardly nearer than thousands of others, so any hash
scheme has to look at a large part to reach the recall asked for (the README has figures); ``share`` and ``trees`` set the trade, and
``share=1`` is exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate; neither do rows without an id; rows with
the query's own id are never its candidates; a query id that occurs in several rows with different vectors is searched by its smallest vector; rows
with equal vectors are indexed once, with the ``k + 1`` smallest ids, which is all that a result can show of them; ties go to the smaller id; an
empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import release, resident, workspace, written

BITS = 64
#: Trees that join at a time while a query ascends by a bit.
STEP = 16


def planes(size: int, trees: int, pool: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hyperplanes, the pool's bits that each tree reads in turn)."""

    def make():
        rng = np.random.default_rng(seed)
        return rng.standard_normal((size, pool)).astype(np.float32), np.stack([rng.permutation(pool)[:BITS] for _ in range(trees)])

    return resident(("planes", size, trees, pool, seed), make)


def strings(units: np.ndarray, trees: int, pool: int, seed: int) -> np.ndarray:
    """The string of each vector in each tree, first bit highest: (trees, vectors)."""
    planes_, reads = planes(units.shape[1], trees, pool, seed)
    signs = np.ascontiguousarray(((units.astype(np.float32) @ planes_) > 0).T)
    out = np.empty((trees, len(units)), dtype=np.uint64)
    for t, own in enumerate(reads):
        out[t] = np.ascontiguousarray(np.packbits(signs[own], axis=0).T).view(">u8")[:, 0]
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length, scaled by their largest component first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Forest:
    """The trees of one block: strings sorted in each tree, and the vectors in that order."""

    def __init__(self, sorted_: np.ndarray, order: np.ndarray):
        self.sorted, self.order, self.n = sorted_, order, order.shape[1]
        self.trees = len(order)
        # First position of each prefix of ``top`` bits, so that the levels of most queries need no search.
        self.top = max(1, min(14, self.n.bit_length()))
        starts = np.arange(1 << self.top, dtype=np.uint64) << np.uint64(BITS - self.top)
        self.first = np.stack([np.append(np.searchsorted(s, starts), self.n) for s in sorted_]).astype(np.int64)

    @classmethod
    def build(cls, units: np.ndarray, trees: int, pool: int, seed: int) -> Forest:
        own = strings(units, trees, pool, seed)
        order = np.argsort(own, axis=1, kind="stable")
        return cls(np.take_along_axis(own, order, axis=1), order)

    def ranges(self, own: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """[first, last) of the vectors that share ``level`` bits with ``own`` (trees, queries)."""
        if level == 0:
            return np.zeros(own.shape, dtype=np.int64), np.full(own.shape, self.n)
        low = own >> np.uint64(BITS - level) << np.uint64(BITS - level)
        if level <= self.top:
            at, row = (low >> np.uint64(BITS - self.top)).astype(np.int64), np.arange(self.trees)[:, None]
            return self.first[row, at], self.first[row, at + (1 << (self.top - level))]
        high = low | np.uint64((1 << (BITS - level)) - 1)
        return tuple(np.stack([np.searchsorted(s, v, side=side) for s, v in zip(self.sorted, x, strict=True)]) for x, side in ((low, "left"), (high, "right")))

    def levels(self, own: np.ndarray, wanted: int) -> np.ndarray:
        """Longest prefix of each query at which the trees together still match ``wanted`` vectors, copies in several trees counted each."""
        out = np.zeros(own.shape[1], dtype=np.int64)
        many = lambda q, level: (lambda a, b: (b - a).sum(axis=0) >= wanted)(*self.ranges(own[:, q], level))
        for level in range(self.top, 0, -1):
            left = np.flatnonzero(out == 0)
            if not len(left):
                break
            out[left[many(left, level)]] = level
        deep = np.flatnonzero(out == self.top)
        low, high = np.full(len(deep), self.top), np.full(len(deep), BITS)
        while (go := low < high).any():  # halving, as counts fall with the level
            middle = (low + high + 1) // 2
            for level in np.unique(middle[go]):
                at = np.flatnonzero(go & (middle == level))
                enough = many(deep[at], int(level))
                low[at[enough]], high[at[~enough]] = level, level - 1
        out[deep] = low
        return out

    def _members(self, first: np.ndarray, last: np.ndarray, trees: slice) -> np.ndarray:
        first, size = first[trees] + np.arange(self.trees)[trees] * self.n, last[trees] - first[trees]
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size)
        return self.order.ravel()[at + np.arange(len(at))]

    def candidates(self, own: np.ndarray, wanted: int):
        """For each query (its strings), the vectors found by descending and ascending, in order."""
        wanted = min(wanted, self.n)
        for q, level in enumerate(self.levels(own, wanted).tolist()):
            mine, hit = own[:, q : q + 1], np.zeros(self.n, dtype=bool)
            if level < BITS:  # all that match longer prefixes
                hit[self._members(*(x[:, 0] for x in self.ranges(mine, level + 1)), slice(None))] = True
            while np.count_nonzero(hit) < wanted:
                first, last = (x[:, 0] for x in self.ranges(mine, level))
                for t in range(0, self.trees, STEP):
                    hit[self._members(first, last, slice(t, t + STEP))] = True
                    if np.count_nonzero(hit) >= wanted:
                        break
                level -= 1
            yield np.flatnonzero(hit)


def usable(embedding: str):
    """Whether a vector takes part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


INDEX = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(T.ArrayType(T.LongType()))), *(T.StructField(x, T.BinaryType()) for x in ("units", "strings", "places"))])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def matrix(t: pa.Table) -> np.ndarray:
    c = t.column("v").combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def build(rows: DataFrame, trees: int, pool: int, block: int, seed: int) -> DataFrame:
    """``INDEX``: a row for each block of ``rows`` (v, ids, size)."""
    blocks = -(-max(1, rows.count()) // block)

    def make(t: pa.Table) -> pa.Table:
        x = unit(matrix(t))
        f = Forest.build(x, trees, pool, seed)
        parts = [x.tobytes(), f.sorted.tobytes(), f.order.astype("<u4").tobytes()]
        ids = pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.Table.from_arrays([pa.array([x.shape[1]], pa.int32()), ids, *(pa.array([p], pa.binary()) for p in parts)], names=INDEX.names)

    return rows.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).groupBy("size", "block").applyInArrow(make, INDEX)


def search(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 256, pool: int = 1024, share: float = 0.42, least: int = 64, block: int = 8192, chunk: int = 8192, seed: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``queries``. A task holds one block, and one chunk of queries."""
    spark = df.sparkSession
    folder = workspace(spark, "forest")
    pick = lambda x: x.where(F.col(vec_id).isNotNull() & usable(embedding)).select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda v: v.cast("double")).alias("v"))
    # Of the rows of one vector, those with the smallest ids; ranks are cut before the shuffle too, so a hot vector is a few rows of each task.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = pick(df).distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    rows = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("size", F.size("v")), f"{folder}/rows")
    index = written(build(rows, trees, pool, block, seed), f"{folder}/index")
    asked = pick(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    chunks = -(-max(1, asked.count()) // chunk)
    asked = written(asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), f"{folder}/queries")

    def found_of(part: int) -> DataFrame:
        own = asked.where(F.col("chunk") == part).orderBy("id").toArrow()  # about ``chunk`` rows
        sizes = own.column("size").to_numpy()
        ask = {}
        for size in np.unique(sizes):
            some = own.filter(pa.array(sizes == size))
            y = unit(matrix(some))
            ask[int(size)] = some.column("id").to_numpy(), y, strings(y, trees, pool, seed)
        shared = spark.sparkContext.broadcast(ask)

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    size, ids, *parts = (c[i] for c in b.columns)
                    asked_ids, y, hashed = shared.value.get(size.as_py(), ([], None, None))
                    if not len(asked_ids):
                        continue
                    x, sorted_, order = (np.frombuffer(p.as_buffer(), dtype=d) for p, d in zip(parts, ("<f8", "<u8", "<u4"), strict=True))
                    x, ids = x.reshape(-1, size.as_py()), ids.as_py()
                    least_id = np.array([own[0] for own in ids])
                    out: list[tuple] = []
                    for q, near in enumerate(Forest(sorted_.reshape(trees, -1), order.reshape(trees, -1)).candidates(hashed, max(least, int(share * len(x))))):
                        score = np.clip(x[near] @ y[q], -1, 1)
                        best = np.lexsort((least_id[near], -score))[: k + 1]
                        own = int(asked_ids[q])
                        out += [(own, v, s) for s, v in sorted((-float(score[j]), v) for j in best for v in ids[near[j]] if v != own)[:k]]
                    cols = list(zip(*out, strict=True)) if out else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([-s for s in cols[2]], pa.float64())], names=FOUND.names)

        return written(index.mapInArrow(run, FOUND), f"{folder}/found/part={part}")

    for part in range(chunks):
        found_of(part)
    release(spark, f"{folder}/index", f"{folder}/rows")
    found = spark.read.schema(FOUND).parquet(*(f"{folder}/found/part={part}" for part in range(chunks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
