"""The corpus pipeline: documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the shared folder and reads it
back for the next. All but the last return the columns of ``documents``.

Defined cases, for each stage: an empty table gives an empty one; a null text counts as empty (no language: rejected by the first stage, an empty line to the
second, kept as a class of its own by the third, the end id alone in the last); texts may have any length; of rows that repeat both id and text the third stage
keeps one, as of equal texts with several ids (the smallest); other columns pass through but for the last stage, whatever their names. Without any
labelled text the first stage rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import jaccard, langid, line_dedup, packing
from wordloom.llm._common import make_room, workspace, written

#: Below this posterior probability no language is accepted.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised; fitted on a bounded sample of the labelled ones."""
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:  # nothing to learn from: nothing is rejected
        return docs
    own, moved = make_room(docs, "lang_pred", "score")
    judged = langid.predict(own, model)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in at least ten documents; documents stay, with the rest of their text."""
    own, moved = make_room(docs, "n_lines", "n_dropped")
    kept = line_dedup.dedup_lines(own, min_docs=10)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of documents linked by a Jaccard similarity of 0.8 on shingles of five words."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Language identification and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{i}-{name}")
    return docs
