"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys are held as 128-bit hashes. Documents
come in batches. A run is a table of (key, number of documents), bucketed and sorted by key. A batch's keys, with the number of its documents that
hold each, go through merge joins with the runs: keys that a run has *decided* (known to be in enough documents) drop out, as an anti-join does;
counts in the runs add to a key's own, and where the sum reaches ``min_docs`` the key is decided from then on; the batch's own counts become a new
run of level 0. Whenever a level holds ``fanout`` runs, they are merged into one run of the next level. After the last batch all levels are
merged, so every count is complete. Documents then lose the lines whose keys are decided.

Everything is DataFrame operations; no key or count goes to the driver. Counts are pre-aggregated before their shuffle, so a
hot key is one row of each task; runs are as bucketed as shuffles are partitioned, so neither joins nor merges shuffle a run. Runs are tables of the
session's catalog while the operator works, their files lie in the shared folder, so a lost executor costs its tasks only.

Defined cases: null or empty text is one empty line; an empty key never goes; equal texts get equal results; each row is a document, repeated
rows too; a key in exactly ``min_docs`` documents goes; a text of any length is split whole, within one row; an empty table gives no rows;
other columns pass through, and those named as one of the results get underscores before their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, make_room, release, workspace, written

#: Fixed value: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """Levelled sorted runs of (key, number of documents); a number of ``min_docs`` says that the key is decided."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.names: list[str] = []

    def _run(self, df: DataFrame) -> DataFrame:
        """Writes (key, n), counts cut off at ``min_docs``, as a run that Spark knows to be bucketed."""
        name = f"wordloom_run_{uuid.uuid4().hex}"
        run = df.select("key", F.least("n", F.lit(self.min_docs)).cast("long").alias("n"))
        run.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key, n), each key once."""
        x = batch.select("key", "n", F.col("n").alias("total"))
        for run in (r for level in self.levels for r in level):
            x = x.hint("merge").join(run.select("key", F.col("n").alias("m")), "key", "left")
            x = x.where(F.coalesce("m", F.lit(0)) < self.min_docs).select("key", "n", (F.col("total") + F.coalesce("m", F.lit(0))).alias("total"))
        self.levels[0].append(self._run(x.select("key", F.when(F.col("total") >= self.min_docs, F.col("total")).otherwise(F.col("n")).alias("n"))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self.levels[level + 1].append(merged)
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        x = runs[0]
        for run in runs[1:]:
            x = x.hint("merge").join(run.withColumnRenamed("n", "m"), "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return self._run(x)

    def close(self) -> DataFrame:
        """Merges every level into one run; returns all decided keys, each once."""
        rest = [r for level in self.levels for r in level]
        self.levels = [[self._merged(rest) if len(rest) > 1 else rest[0]]]
        return self.levels[0][0].where(F.col("n") >= self.min_docs).select("key")

    def drop(self) -> None:
        """Takes the runs out of the catalog and deletes their files."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
            release(self.spark, f"{self.folder}/{name}")


#: Documents of a batch, beyond the least number of batches.
BATCH_DOCS = 1 << 26


def dedup_lines(df: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``df`` with ``text`` rid of lines whose key is in at least ``min_docs`` documents, and ``n_lines`` (before), ``n_dropped``.

    There are at least ``batches`` batches, and one for each ``BATCH_DOCS`` documents.
    """
    df, moved = make_room(df, "n_lines", "n_dropped")
    text = moved.get(text, text)
    spark = df.sparkSession
    folder = workspace(spark, "lines")
    whole = F.md5(F.coalesce(F.col(text), F.lit("")))
    keys = F.transform(lines_of(F.col(text)), lambda x: F.when(F.char_length(line_key(x)) >= min_chars, F.md5(line_key(x))))
    batches = max(batches, -(-df.count() // BATCH_DOCS))
    # One pass over the texts: for each document, the hashes of its lines in order.
    df.select(whole.alias("whole"), keys.alias("keys"), F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch")).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("whole string, keys array<string>, batch int").parquet(f"{folder}/lines")
    runs = Runs(spark, folder, min_docs, fanout)
    for b in range(batches):
        own = lines.where(F.col("batch") == b).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(own.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")))
    common = written(runs.close(), f"{folder}/common")
    runs.drop()
    # Positions to drop, for each distinct text: copies are merged before the shuffle.
    at = lines.select("whole", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull())
    mark, drops_ = free_name("_whole", df.columns), free_name("_drops", df.columns)
    drops = at.join(common, "key", "left_semi").groupBy("whole").agg(F.sort_array(F.collect_set("pos")).alias(drops_)).withColumnRenamed("whole", mark)
    drops = written(drops, f"{folder}/drops")
    release(spark, f"{folder}/lines", f"{folder}/common")
    x = df.withColumn(mark, whole).join(drops, mark, "left")
    parts = lines_of(F.col(text))
    before = F.concat(F.array(F.lit(-1)), F.col(drops_))
    after = F.concat(F.col(drops_), F.array(F.size(parts)))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 2, b - a - 1)))
    n_lines = F.size(parts).cast("long")
    n_dropped = F.when(F.col(drops_).isNull(), F.lit(0)).otherwise(F.size(drops_)).cast("long")
    out = x.withColumns({"n_lines": n_lines, "n_dropped": n_dropped, text: F.when(F.col(drops_).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n"))})
    return out.select(*df.columns, "n_lines", "n_dropped")
