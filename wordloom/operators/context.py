"""Context windows and the word pairs in them, by slicing each sentence's array: no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import uniform

CONTEXT = 5


def static_size(left: Column, right: Column, c: int = CONTEXT) -> tuple[Column, Column]:
    return F.least(left, F.lit(c)), F.least(right, F.lit(c))


def dynamic_reach(c: int, *key) -> Column:
    """One draw from 1 to ``c`` for a centre, used on both sides."""
    return (1 + F.floor(uniform(*key) * c)).cast("int")


def _windows(sentences: DataFrame, key: list[str], ids: str, reach) -> DataFrame:
    x = sentences.select(*key, F.col(ids).alias("_ids"), F.posexplode(ids).alias("_p", "target"))
    x = x.withColumn("_s", reach(F.col("_p") + 1))
    left = F.slice("_ids", F.greatest(F.col("_p") - F.col("_s") + 1, F.lit(1)), F.least(F.col("_p"), F.col("_s")))
    return x.withColumn("_ctx", F.concat(left, F.slice("_ids", F.col("_p") + 2, F.col("_s"))))


def pairs(sentences: DataFrame, key: list[str], ids: str = "ids", c: int = CONTEXT, dynamic: str | None = None) -> DataFrame:
    """key, pos, target, context: every pair of a centre and a word within its reach, left to right.

    ``dynamic`` names the draws of a reach for each centre; without it the reach is ``c``.
    """
    reach = (lambda pos: dynamic_reach(c, dynamic, *[F.col(k) for k in key], pos)) if dynamic else (lambda pos: F.lit(c))
    x = _windows(sentences, key, ids, reach)
    # The outer form, with a filter behind it: else the optimizer would draw and slice once more for each centre, to ask whether it has a window.
    x = x.select(*key, (F.col("_p") + 1).cast("long").alias("pos"), "target", F.posexplode_outer("_ctx").alias("_q", "context"))
    return x.where(F.col("_q").isNotNull()).drop("_q")


def has_oov(ids: str | Column) -> Column:
    return F.exists(F.col(ids) if isinstance(ids, str) else ids, lambda x: x < 0)
