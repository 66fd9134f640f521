"""Token streams out of text columns and vocabulary files.

A carriage return is deleted wherever it stands; words end at spaces, tabs and newlines; a newline ends a sentence, blank lines
are empty sentences, and a sentence holds at most ``limit`` words.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE_LIMIT = 1000


def _lines(df: DataFrame, keys: list[str], text: str, drop_unterminated: bool) -> DataFrame:
    """keys, line_no, ws: the words of each line; the piece after a final newline is no line unless it has words.

    What the end of a text decides is done on the text, before it is split: nothing is computed again for each line.
    """
    body = F.replace(F.col(text), F.lit("\r"), F.lit(""))
    if drop_unterminated:  # the stream form: what no separator follows is no word
        body = F.regexp_replace(body, r"[^ \t\n]+\z", "")
    x = df.where(F.col(text).isNotNull()).select(*keys, body.alias("_text")).where(~F.col("_text").rlike(r"\A[ \t]*\z"))
    x = x.select(*keys, F.posexplode(F.split(F.regexp_replace("_text", r"\n[ \t]*\z", ""), "\n", -1)).alias("_p", "_line"))
    return x.select(*keys, (F.col("_p") + 1).cast("long").alias("line_no"), F.filter(F.split("_line", "[ \t]+"), lambda w: w != "").alias("ws"))


def lines(df: DataFrame, keys: list[str], text: str = "text", drop_unterminated: bool = False) -> DataFrame:
    return _lines(df, keys, text, drop_unterminated)


def tokens(df: DataFrame, keys: list[str], text: str = "text", drop_unterminated: bool = False) -> DataFrame:
    """keys, line_no, pos, word; both count from 1."""
    x = _lines(df, keys, text, drop_unterminated)
    # The outer form, with a filter behind it: else the optimizer would split each line again to ask whether it has words.
    x = x.select(*keys, "line_no", F.posexplode_outer("ws").alias("_p", "word")).where(F.col("word").isNotNull())
    return x.select(*keys, "line_no", (F.col("_p") + 1).cast("long").alias("pos"), "word")


def sentences(df: DataFrame, keys: list[str], text: str = "text", limit: int = SENTENCE_LIMIT, drop_unterminated: bool = False) -> DataFrame:
    """keys, line_no, chunk, ws: sentences of at most ``limit`` words."""
    x = _lines(df, keys, text, drop_unterminated)
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ws") - 1) / limit).cast("int")))
    x = x.withColumn("chunk", F.explode(chunks))
    return x.select(*keys, "line_no", F.col("chunk").cast("long").alias("chunk"), F.slice("ws", F.col("chunk").cast("int") * limit + 1, limit).alias("ws"))


def readable(spark: SparkSession, path: str) -> None:
    """Fails with a plain message where a source can't be read."""
    try:
        spark.read.text(path).limit(1).count()
    except AnalysisException as e:
        raise OSError(f"cannot be read: {path}") from e


FILE_KEY = ["file", "block", "line"]


def text_file(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A text file, or folder of them: (file, block, line, text), which sort in file order.

    Files are read in splits, a row for each line. ``whole`` reads a file as one row, for the stream form that drops an unterminated last word.
    """
    readable(spark, path)
    if whole:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), F.col("value").alias("text"))
    x = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return x.select("file", "block", F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def vocab_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) out of lines ``word count``; a word's counts add up; another line fails."""
    readable(spark, path)
    pattern = r"^(\S+) (\d+)$"
    x = spark.read.text(path).where("value <> ''")
    count = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 2).cast("long")).otherwise(F.raise_error(F.concat(F.lit("malformatted vocabulary: "), "value")).cast("long"))
    return x.select(F.regexp_extract("value", pattern, 1).alias("word"), count.alias("count")).groupBy("word").agg(F.sum("count").alias("count"))


def vocab_lines(vocab: DataFrame, counts: bool = True):
    """(word_id, line): the text form of a vocabulary."""
    return vocab.select("word_id", (F.concat_ws(" ", "word", F.col("count").cast("string")) if counts else F.col("word")).alias("line"))


def write_vocab(vocab: DataFrame, path: str, counts: bool = True) -> None:
    """Writes the text form in id order."""
    vocab_lines(vocab, counts).orderBy("word_id").select("line").write.mode("overwrite").text(path)
