"""Tables in the folder that driver and executors share, and reading of the driver's tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in a local session that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may have ended already; the folder is then left to its owner
        pass


def workspace(spark: SparkSession, tag: str) -> str:
    """A new folder for one run of an operator, in the shared folder; deleted when the driver ends."""
    path = f"{shared_root(spark)}/wordloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes tables in the shared folder that nothing reads any more.

    Spark removes the shuffle files of finished queries when its driver collects garbage, so that is asked for, too: else they fill the disks of a long run.
    """
    for path in paths:
        _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: lineage ends at files that every executor can read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order, name: str = "word_id") -> DataFrame:
    """``df`` with dense numbers from 0 in a total ``order``, without a global window.

    The rows are range-partitioned and sorted once and written; a partition's first number is the sum of the sizes
    of those before it, so only one number for each partition reaches the driver.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    x = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), workspace(spark, "ranked"))
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(tuple(r) for r in x.groupBy(part.alias("part")).count().collect())
    first, starts = 0, []
    for p, n in sizes:
        starts += [F.lit(p), F.lit(first)]
        first += n
    if not starts:
        return x.select(*df.columns, F.lit(None).cast("long").alias(name))
    start = F.create_map(*starts)[part]
    return x.select(*df.columns, (start + F.col("_at") - F.shiftleft(part.cast("long"), 33)).cast("long").alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
