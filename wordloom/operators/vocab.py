"""Exact vocabularies: counts, ids, lookups, out-of-vocabulary filters and subsampling.

A vocabulary is a table (word_id, word, count) with dense ids from 0. A truncated one is bounded by its size, which the caller sets, so
lookups may broadcast it; ``lookup`` does so below ``BROADCAST_WORDS`` and joins by shuffle beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import uniform
from ..sources.tables import ranked

VOCABULARY, THRESHOLD = 16_000, 1e-3
#: Words of at most some tens of bytes: far below what an executor holds.
BROADCAST_WORDS = 200_000


def counts(tokens: DataFrame) -> DataFrame:
    """(word, count); partial counts before the shuffle."""
    return tokens.groupBy("word").agg(F.count("*").alias("count"))


def first_seen(tokens: DataFrame, *order: str) -> DataFrame:
    """(word_id, word, count) with ids by first appearance in ``order``."""
    x = tokens.groupBy("word").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("count"))
    return ranked(x, "_first").select("word_id", "word", "count")


def truncate(vocab: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The ``size`` most frequent words, ids by falling count, then by word.

    The limit is a distributed top-k; only its rows meet in the window that numbers them.
    """
    top = vocab.select("word", "count").orderBy(F.desc("count"), "word").limit(size)
    return top.select((F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).cast("long").alias("word_id"), "word", "count")


def sort(vocab: DataFrame) -> DataFrame:
    """All words, ids by falling count, then by word."""
    return ranked(vocab.select("word", "count"), F.desc("count"), "word").select("word_id", "word", "count")


def exact_lm(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    return truncate(counts(tokens), size)


def from_counts(words: DataFrame) -> DataFrame:
    """A vocabulary from (word, count) rows, as out of a vocabulary file."""
    return sort(words.groupBy("word").agg(F.sum("count").alias("count")))


def summary(vocab: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row: size, total, capacity."""
    return vocab.agg(F.count("*").alias("size"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total"), F.lit(capacity).cast("long").alias("capacity"))


def ordered_counts(vocab: DataFrame) -> DataFrame:
    """(rank, count), falling; rank from 0."""
    return ranked(vocab.select("count", "word"), F.desc("count"), "word", name="rank").select("rank", "count")


def _side(vocab: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(vocab) if size is not None and size <= BROADCAST_WORDS else vocab


def lookup(tokens: DataFrame, vocab: DataFrame, size: int | None = VOCABULARY) -> DataFrame:
    """``tokens`` with word_id, -1 for words out of vocabulary. ``size``: the vocabulary's bound, None where there is none."""
    return tokens.join(_side(vocab.select("word", "word_id"), size), "word", "left").withColumn("word_id", F.coalesce("word_id", F.lit(-1).cast("long")))


def in_vocabulary(tokens: DataFrame, vocab: DataFrame, size: int | None = VOCABULARY) -> DataFrame:
    """``tokens`` of known words, with word_id and count."""
    return tokens.join(_side(vocab, size), "word")


def reverse_lookup(ids: DataFrame, vocab: DataFrame, size: int | None = VOCABULARY, strict: bool = False) -> DataFrame:
    """word and count of each word_id; unknown ids give no row, or fail the query where ``strict``."""
    if not strict:
        return ids.join(_side(vocab, size), "word_id")
    x = ids.join(_side(vocab.withColumn("_known", F.lit(True)), size), "word_id", "left")
    fail = F.raise_error(F.concat(F.lit("unknown word id: "), F.col("word_id").cast("string"))).cast("string")
    return x.withColumn("word", F.when(F.col("_known"), F.col("word")).otherwise(fail)).drop("_known")


def keep_probability(count, total, threshold: float = THRESHOLD):
    """P(a token stays): min(1, sqrt(threshold * total / count))."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(threshold)) * total / count))


def subsample(tokens: DataFrame, vocab: DataFrame, total: int, key: list[str], threshold: float = THRESHOLD, seed: str = "s", size: int | None = VOCABULARY) -> DataFrame:
    """Known tokens that survive frequent-word subsampling; each draw depends on ``key`` alone."""
    x = in_vocabulary(tokens, vocab, size)
    u = uniform(seed, *[F.col(k) for k in key])
    return x.where(u > 1 - F.sqrt(F.lit(float(threshold)) * total / F.col("count"))).drop("count")


def encode_in_place(sentences: DataFrame, vocab: DataFrame, key: list[str], total: int = 0, threshold: float | None = None, seed: str = "s") -> DataFrame:
    """key, ids: word ids of each sentence (``ws``: its words) in order, gaps closed; with ``threshold`` less what subsampling drops. Sentences left empty go.

    Words are looked up in their arrays, a batch at a time: nothing is exploded, shuffled or grouped again. For vocabularies of at most
    ``BROADCAST_WORDS`` words, which go to each task. A draw depends on the key and the word's position alone.
    """
    rows = vocab.select("word", "word_id", "count").orderBy("word_id").limit(BROADCAST_WORDS + 1).collect()
    if len(rows) > BROADCAST_WORDS:
        raise ValueError(f"a vocabulary of more than {BROADCAST_WORDS} words is joined, not sent to tasks")
    known, ids = pa.array([r["word"] for r in rows], pa.string()), np.array([r["word_id"] for r in rows], dtype=np.int64)
    keep = None if threshold is None else np.sqrt(threshold * total / np.array([r["count"] for r in rows], dtype=float)) if rows else np.zeros(0)
    fields = [sentences.schema[k] for k in key]
    x = sentences.select(*key, F.xxhash64(F.lit(seed), *key).alias("_h"), "ws")

    def run(batches):
        for b in batches:
            ws = b.column(len(key) + 1)
            parent, found = pc.list_parent_indices(ws).to_numpy(), pc.index_in(ws.flatten(), value_set=known)
            at = pc.fill_null(found, -1).to_numpy()
            stays = at >= 0
            if keep is not None and len(at):
                first = np.searchsorted(parent, parent)
                z = b.column(len(key)).to_numpy().astype(np.uint64)[parent] + (np.arange(len(at)) - first + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(by))) * np.uint64(factor)
                stays &= (z >> np.uint64(11)) * 2.0**-53 > 1 - keep[at]
            sizes = np.bincount(parent[stays], minlength=b.num_rows)
            full = np.flatnonzero(sizes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[full])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids[at[stays]]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(full)) for i in range(len(key))), lists], names=[*key, "ids"])

    return x.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.LongType()))]))


def encode_sentences(tokens: DataFrame, key: list[str]) -> DataFrame:
    """key, ids: word ids of each sentence in order, gaps closed. ``tokens``: key, pos, word_id."""
    x = tokens.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "word_id"))).alias("x"))
    return x.select(*key, F.transform("x", lambda e: e["word_id"]).alias("ids"))


