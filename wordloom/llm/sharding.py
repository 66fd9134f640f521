"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group. Groups are dealt into a fixed number of buckets by hash; a group that alone is over a
``1 / grain`` of a shard in bytes, tokens or rows stands outside the buckets and is split by a hash of its rows, so that
a text with a third of all rows still spreads. These atoms, whose number is bounded by parameters whatever the input
(at most ``buckets`` plus twice three times ``shards * grain``), go to the driver as four numbers each; largest first, each is
placed in the shard where the dot product of its vector with the residual capacity is highest. Moves and swaps of atoms
between the fullest and the emptiest shard then even out the bytes. The law that holds is ``bytes``: sizes near equal.

Slots are gapless without a shard in one task: atoms' row counts give each atom its first slot, and rows are numbered
within their atom.

Defined cases: null text has no bytes and no tokens, checksum 0, and forms a group; ids may be null or repeat: rows are numbered within their atom by id, size and
checksum, and equal ones in any order, which their columns don't show; a text of any length is one row of its size, and a shard can then hold no less; an empty
table gives no rows; other columns are left out of the result, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import workspace, written

LAW = "bytes"


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each atom; ``vectors``: bytes, tokens and rows of each."""
    total = np.maximum(vectors.sum(axis=0), 1)
    v = vectors / total * shards  # a shard's capacity is 1 in each dimension
    residual = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), dtype=np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1))):
        k = int(np.argmax(residual @ v[i]))
        out[i] = k
        residual[k] -= v[i]
    return even(vectors[:, 0].astype(np.int64), out, shards)


def even(size: np.ndarray, at: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Moves or swaps atoms between the fullest and the emptiest shard while that narrows the gap."""
    load = np.bincount(at, weights=size, minlength=shards).astype(np.int64)
    for _ in range(rounds):
        a, b = int(load.argmax()), int(load.argmin())
        gap = load[a] - load[b]
        mine, theirs = np.flatnonzero(at == a), np.flatnonzero(at == b)
        if gap <= 1 or not len(mine):
            break
        # What leaves a, less what comes back from b, should be half the gap; "nothing" may come back.
        order = theirs[np.argsort(size[theirs], kind="stable")]
        back = np.concatenate([[0], size[order]])
        want = np.clip(np.searchsorted(back, size[mine] - gap // 2), 0, len(back) - 1)
        near = np.stack([want, np.maximum(want - 1, 0)])
        left = np.abs(gap - 2 * (size[mine] - back[near]))
        w, i = np.unravel_index(int(left.argmin()), left.shape)
        if left[w, i] >= gap:
            break
        j = near[w, i]
        moved = size[mine[i]] - back[j]
        at[mine[i]] = b
        if j:
            at[order[j - 1]] = a
        load[a] -= moved
        load[b] += moved
    return at


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16, buckets: int = 16_384, grain: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), tokens."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.when(body == "", 0).otherwise(F.char_length(body) - F.char_length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")
    slim = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), tokens.alias("tokens"), F.crc32(body).alias("text_crc32"), F.xxhash64(text).alias("_group"))
    rows = written(slim, workspace(spark, "shards"))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("_group").agg(*sums)
    total = groups.agg(F.sum("size"), F.sum("tokens"), F.sum("rows")).first()
    most = [max(1.0, (t or 0) / (shards * grain)) for t in total]
    share = F.greatest(*[F.col(c) / F.lit(m) for c, m in zip(("size", "tokens", "rows"), most, strict=True)])
    # At most three times shards * grain groups are over; each is split into as many parts as it is times over.
    heavy = groups.where((share > 1) & (F.col("rows") > 1)).select("_group", F.least(F.ceil(share), F.col("rows")).cast("long").alias("parts")).sort("_group").collect()
    first, table = buckets, []
    for g, parts in heavy:
        table.append((g, first, parts))
        first += parts
    table = spark.createDataFrame(table, "_group long, _first long, _parts long")
    dealt = rows.join(F.broadcast(table), "_group", "left").withColumn("_atom", F.when(F.col("_first").isNull(), F.pmod("_group", F.lit(buckets))).otherwise(F.col("_first") + F.pmod(F.xxhash64("doc_id", F.lit(7)), "_parts")))
    atoms = sorted(tuple(r) for r in dealt.groupBy("_atom").agg(*sums).collect())
    vectors = np.array([a[1:] for a in atoms], dtype=np.float64).reshape(len(atoms), 3)
    at = place(vectors, shards) if atoms else []
    filled, placed = [0] * shards, []
    for (atom, *_, n), k in zip(atoms, at, strict=True):
        placed.append((atom, int(k), filled[k]))
        filled[k] += n
    placed = spark.createDataFrame(placed, "_atom long, shard int, _start long")
    number = F.row_number().over(Window.partitionBy("_atom").orderBy("doc_id", "size", "text_crc32"))
    out = dealt.withColumn("_n", number).join(F.broadcast(placed), "_atom")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
