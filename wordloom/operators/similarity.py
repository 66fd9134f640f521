"""Nearest neighbours among embeddings: cosine of word vectors, or fit to a context. All candidates are looked at, a chunk of queries at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import GRID, SIGMOID_LIMIT, cosine, fast_sigmoid_array
from ..sources.tables import workspace, written

#: Queries that are broadcast at a time; candidates, and queries or their context rows, that are scored at a time.
CHUNK, ROWS, BLOCK = 4096, 2048, 256
#: The most that the sigmoid rises in a step of the fast one's grid: a quarter of its width.
STEP = 2 * SIGMOID_LIMIT / (GRID - 1) / 4
#: Pairs that are measured in double precision at a time, and scores that count as equal.
EXACT, EQUAL = 1 << 13, 1e-12


def pair_similarity(pairs: DataFrame, vectors: DataFrame, key: str = "word_id", vector: str = "word_vec") -> DataFrame:
    """``pairs`` (a, b) with their cosine; null where a vector is zero."""
    left = vectors.select(F.col(key).alias("a"), F.col(vector).alias("_x"))
    right = vectors.select(F.col(key).alias("b"), F.col(vector).alias("_y"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, cosine("_x", "_y").alias("similarity"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _scan(have: DataFrame, asked: DataFrame, chunk: int, prepare, best_of, name: str, value: str) -> DataFrame:
    """(name, neighbor_id, value): the best candidate of ``have`` (id, v) for each query of ``asked`` (key, ...).

    Queries go in chunks of about ``chunk``, each broadcast to one scan of the candidates; a task yields its best for each query. Neither side is
    copied or shuffled for the other. ``prepare`` makes a query set of an Arrow table, ``best_of(keys, queries, ids, vectors)`` gives the best score of each
    query among candidates of rising ids (-inf where there is none) and its position, the first of equal ones.
    """
    spark, kind = asked.sparkSession, f"{name} long, neighbor_id long, {value} double"
    folder = workspace(spark, "neighbours")
    chunks = -(-max(1, asked.count()) // chunk)
    asked = written(asked.withColumn("_chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")), f"{folder}/asked")
    have = written(have.select("id", "v").repartition(spark.sparkContext.defaultParallelism), f"{folder}/have")  # a scan keeps all cores at work
    for part in range(chunks):
        t = asked.where(F.col("_chunk") == part).drop("_chunk").orderBy("key").toArrow()  # about ``chunk`` rows
        shared = spark.sparkContext.broadcast((t.column("key").to_numpy(), prepare(t)))

        def run(batches, shared=shared):
            keys, queries = shared.value
            best, at = np.full(len(keys), -np.inf), np.full(len(keys), -1, dtype=np.int64)
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    b = whole.slice(k, ROWS)
                    order = np.argsort(b.column(0).to_numpy(), kind="stable")
                    ids = b.column(0).to_numpy()[order]
                    if not len(keys) or not len(ids):
                        continue
                    top, i = best_of(keys, queries, ids, _matrix(b.column(1))[order])
                    won = (top > best + EQUAL) | ((top >= best - EQUAL) & (top > -np.inf) & (ids[i] < at))
                    best[won], at[won] = top[won], ids[i][won]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), pa.array(best)], names=[name, "neighbor_id", value])

        written(have.mapInArrow(run, kind), f"{folder}/found/part={part}")
        shared.unpersist()
    found = spark.read.schema(kind).parquet(*(f"{folder}/found/part={part}" for part in range(chunks)))
    return _top(found, name, value)


def nearest_neighbor(vectors: DataFrame, queries: DataFrame | None = None, key: str = "word_id", vector: str = "word_vec", chunk: int = CHUNK) -> DataFrame:
    """(query_id, neighbor_id, similarity): the most similar other id; ties to the lowest; -1 and null where there is none."""
    asked = (vectors if queries is None else queries).select(F.col(key).alias("key"), F.col(vector).alias("v"))

    def prepare(t: pa.Table):
        y = _matrix(t.column("v"))
        return (y, *_units(y))

    def best_of(keys, queries, ids, x):
        (y, size, unit), (length, x32) = queries, _units(x)
        top, at = np.full(len(keys), -np.inf), np.zeros(len(keys), dtype=np.int64)
        for k in range(0, len(keys), BLOCK):
            own = slice(k, k + BLOCK)
            s = unit[own] @ x32.T
            s[:, length == 0] = -np.inf
            s[size[own] == 0] = -np.inf
            lo, hi = (np.searchsorted(ids, keys[own], side) for side in ("left", "right"))
            while (is_self := np.flatnonzero(lo < hi)).size:
                s[is_self, lo[is_self]] = -np.inf
                lo[is_self] += 1
            exact = lambda r, c, k=k: np.einsum("nd,nd->n", y[k + r], x[c]) / (size[k + r] * length[c])
            top[own], at[own] = _refined(s, np.full(len(s), 2e-5 * max(1, x.shape[1] / 64), dtype=np.float32), exact)
        return top, at

    return _scan(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), asked, chunk, prepare, best_of, "query_id", "similarity")


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, 0 for vectors without a direction, and unit vectors in single precision."""
    n = np.sqrt((x * x).sum(1))
    n = np.where(np.isfinite(n), n, 0.0)
    return n, np.where(n[:, None] > 0, x / np.where(n, n, 1)[:, None], 0).astype(np.float32)


def _refined(s: np.ndarray, margin: np.ndarray, exact) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each row and the first position that has it, -inf and 0 where there is none.

    ``s`` is near the scores: who is less than ``margin`` behind a row's largest value may be best, and ``exact(rows, columns)`` gives its score.
    """
    top, at = np.full(len(s), -np.inf), np.zeros(len(s), dtype=np.int64)
    r, c = np.nonzero(s >= (np.maximum(s.max(axis=1), np.float32(-3e38)) - margin)[:, None])
    if not len(r):
        return top, at
    v = np.concatenate([exact(r[k : k + EXACT], c[k : k + EXACT]) for k in range(0, len(r), EXACT)])
    v = np.where(np.isnan(v), -np.inf, v)
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    best = np.maximum.reduceat(v, first)
    equal = v >= np.repeat(best, np.diff(first, append=len(r))) - EQUAL
    top[r[first]], at[r[first]] = best, np.minimum.reduceat(np.where(equal, c, s.shape[1]), first)
    return top, at


def _top(x: DataFrame, key: str, value: str) -> DataFrame:
    """Best of the tasks."""
    v = F.when(F.col("neighbor_id") < 0, F.lit(None)).otherwise(F.col(value))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(F.round("_v", 12)), "neighbor_id"))
    return x.withColumn("_v", v).withColumn("_r", rank).where("_r = 1").select(key, "neighbor_id", F.col("_v").alias(value))


def context_nearest_neighbor(model: DataFrame, contexts: DataFrame, key: str = "context_id", ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """(context_id, neighbor_id, score): the word whose vector fits a context best: the sum of fast sigmoids with its context vectors.

    ``model``: word_id, word_vec, context_vec. Negative ids are skipped; a context without any known id scores 0 everywhere and gives the lowest id.
    """
    x = contexts.select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("pos", "word_id"))
    x = x.join(model.select("word_id", "context_vec"), "word_id", "left").groupBy("key").agg(F.collect_list("context_vec").alias("vs"))

    def prepare(t: pa.Table):
        vs = t.column("vs").combine_chunks()
        sizes = np.diff(vs.offsets.to_numpy()) if len(vs) else np.zeros(0, dtype=np.int64)
        return _matrix(vs.flatten()) if sizes.sum() else np.zeros((0, 1)), np.concatenate([[0], np.cumsum(sizes)])

    def best_of(keys, queries, ids, w):
        rows, ends = queries
        sizes, top, at = np.diff(ends), np.zeros(len(keys)), np.zeros(len(keys), dtype=np.int64)
        scale = (np.abs(rows).max(initial=0) * np.abs(w).max(initial=0)) * w.shape[1]  # at least any product
        smooth = np.isfinite(scale) and scale < 1e4
        known, w32, a = np.flatnonzero(sizes), w.astype(np.float32) if smooth else None, 0
        while a < len(known):
            last = max(a + 1, int(np.searchsorted(ends[known + 1], ends[known[a]] + BLOCK, side="right")))
            some = known[a:last]
            lo, hi, a = ends[some[0]], ends[some[-1] + 1], last
            start, s = ends[some] - lo, np.zeros((len(some), len(ids)), dtype=np.float32)
            if smooth:  # the sigmoid itself is at most a step of the grid above the fast one
                for k in range(lo, hi, BLOCK):
                    x = rows[k : min(hi, k + BLOCK)].astype(np.float32) @ w32.T
                    np.negative(x, out=x)
                    with np.errstate(over="ignore"):
                        np.exp(x, out=x)
                    x += 1
                    np.reciprocal(x, out=x)
                    if hi - lo > BLOCK:  # one long context
                        s += x.sum(axis=0)
                        continue
                    for p in range(int(sizes[some].max())):
                        on = np.flatnonzero(sizes[some] > p)
                        s[on] += x[start[on] + p]

            def exact(r, c, some=some):
                v, q = np.zeros(len(r)), some[r]
                for k in range(int(sizes[some].max())):
                    on = np.flatnonzero(sizes[q] > k)
                    x = np.einsum("nd,nd->n", rows[ends[q[on]] + k], w[c[on]])
                    v[on] += np.where(np.isnan(x), np.nan, fast_sigmoid_array(np.nan_to_num(x)))
                return v

            margin = sizes[some] * (STEP + 1e-6 * (10 + scale * max(1, w.shape[1] / 32)) + 1e-7 * sizes[some]) if smooth else np.full(len(some), np.inf)
            top[some], at[some] = _refined(s, margin.astype(np.float32), exact)
        return top, at

    return _scan(model.select(F.col("word_id").alias("id"), F.col("word_vec").alias("v")), x, chunk, prepare, best_of, key, "score")
