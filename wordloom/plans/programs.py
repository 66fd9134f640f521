"""The end-to-end programs: training and printing of vocabularies and embeddings, on text files and model folders.

Each is a function of a session, paths and settings; ``python -m wordloom PROGRAM ...`` calls them. Model folders are Parquet tables
with their settings (``sources.models``).
"""

from __future__ import annotations

import contextlib
import logging
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sgns, sketch, vocab
from ..sources import models, text

log = logging.getLogger("wordloom")


def _report(name: str, words: int, began: float) -> None:
    s = max(time.time() - began, 1e-9)
    log.info("%s: %.1f kwords in %.1f s, %.1f kwords/s", name, words / 1e3, s, words / 1e3 / s)


@contextlib.contextmanager
def _progress(spark: SparkSession, name: str, every: float = 5.0):
    """Logs the tasks done and running every ``every`` seconds while the block runs."""
    stop, began = threading.Event(), time.time()

    def tell() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not stop.wait(every):
            stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            log.info("%s: %.0f s, %d of %d tasks of the stages at work", name, time.time() - began, sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

    t = threading.Thread(target=tell, daemon=True)
    t.start()
    try:
        yield
    finally:
        stop.set()
        t.join()


def _tokens(spark: SparkSession, source: str, parity: bool) -> DataFrame:
    return text.tokens(text.text_file(spark, source, whole=parity), text.FILE_KEY, drop_unterminated=parity)


def naive_lm_train(spark, source: str, out: str, vocabulary: int = vocab.VOCABULARY, threshold: float = vocab.THRESHOLD, parity: bool = False) -> None:
    began = time.time()
    v = vocab.exact_lm(_tokens(spark, source, parity), vocabulary)
    models.save(out, {"kind": "exact", "capacity": vocabulary, "threshold": threshold}, vocab=v)
    _report("naive-lm-train", spark.read.parquet(f"{out}/vocab").agg(F.sum("count")).first()[0] or 0, began)


def spacesaving_lm_train(spark, source: str, out: str, vocabulary: int = vocab.VOCABULARY, threshold: float = vocab.THRESHOLD, merged: bool = False, parity: bool = False) -> None:
    began = time.time()
    lines = text.lines(text.text_file(spark, source, whole=parity), text.FILE_KEY, drop_unterminated=parity)
    v = sketch.merged(_tokens(spark, source, parity), vocabulary) if merged else sketch.exact_order(lines, vocabulary, *text.FILE_KEY, "line_no")
    models.save(out, {"kind": "space-saving", "capacity": vocabulary, "threshold": threshold}, vocab=v)
    _report("spacesaving-lm-train", spark.read.parquet(f"{out}/vocab").agg(F.sum("count")).first()[0] or 0, began)


def vocab_to_naive_lm(spark, source: str, out: str, threshold: float = vocab.THRESHOLD) -> None:
    v = vocab.from_counts(text.vocab_file(spark, source))
    models.save(out, {"kind": "exact", "capacity": v.count(), "threshold": threshold}, vocab=v)


def lm_print(spark, model: str, out: str, counts: bool = False) -> None:
    text.write_vocab(models.load(spark, model, "vocab")[1]["vocab"], out, counts)


def word2vec_train(spark, source: str, out: str, vocabulary: int = vocab.VOCABULARY, dim: int = sgns.DIM, threshold: float = vocab.THRESHOLD, negatives: int = sgns.NEGATIVES, context: int = sgns.CONTEXT, kappa: float = sgns.KAPPA, lm: str | None = None, noise: str = "discrete", exact: bool = False, epochs: int = 1, parity: bool = False, resume: str | None = None) -> None:
    """Two passes: the vocabulary (or a given one), then embeddings; ``resume``: a model folder whose rows and rates training goes on from."""
    began = time.time()
    x = _tokens(spark, source, parity)
    v = models.load(spark, lm, "vocab")[1]["vocab"] if lm else vocab.exact_lm(x, vocabulary)
    models.save(out, {"kind": "exact", "capacity": vocabulary, "threshold": threshold, "dim": dim}, vocab=v)
    v = spark.read.parquet(f"{out}/vocab")
    total = v.agg(F.sum("count")).first()[0] or 0
    key = [*text.FILE_KEY, "line_no", "chunk"]
    if v.count() <= vocab.BROADCAST_WORDS:
        lines = text.sentences(text.text_file(spark, source, whole=parity), text.FILE_KEY, drop_unterminated=parity)
        sentences = vocab.encode_in_place(lines, v, key, total, threshold)
    else:
        cut = x.withColumn("chunk", F.expr(f"(pos - 1) div {text.SENTENCE_LIMIT}"))
        sentences = vocab.encode_sentences(vocab.subsample(cut, v, total, [*key, "pos"], threshold, size=None), key)
    with _progress(spark, "word2vec-train"):
        m = sgns.train(sentences, v, dim, negatives, context, kappa, noise=noise, exact=exact, epochs=epochs, order=tuple(key), resume=spark.read.parquet(f"{resume}/embedding") if resume else None)
        m.write.mode("overwrite").parquet(f"{out}/embedding")
    _report("word2vec-train", total, began)


def spacesaving_word2vec_train(spark, source: str, out: str, vocabulary: int = vocab.VOCABULARY, dim: int = sgns.DIM, threshold: float = vocab.THRESHOLD, negatives: int = sgns.NEGATIVES, context: int = sgns.CONTEXT, kappa: float = sgns.KAPPA, tau: float = sgns.TAU, reservoir: int = 100_000_000) -> None:
    """One pass over a folder of text files, as a stream."""
    from ..streaming import stateful

    began = time.time()
    lines = spark.readStream.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    s = stateful.sgns_stream(text.sentences(lines, ["file"]), vocabulary, ["file", "line_no", "chunk"], dim, negatives, context, kappa, tau, threshold, reservoir)
    m = stateful.run_to_end(s, "word2vec")
    models.save(out, {"kind": "space-saving", "capacity": vocabulary, "threshold": threshold, "dim": dim}, vocab=m.select("word_id", "word", "count"), embedding=m.select("word_id", "word", "word_vec"))
    _report("spacesaving-word2vec-train", spark.read.parquet(f"{out}/vocab").agg(F.sum("count")).first()[0] or 0, began)


def word2vec_print(spark, model: str, out: str, words: bool = False, dims: bool = False) -> None:
    models.write_embeddings(spark.read.parquet(f"{model}/embedding"), out, word="word" if words else None, dims=dims)
