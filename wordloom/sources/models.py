"""Embedding models as files: the binary interchange format, text lines, and Parquet model folders."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_word2vec(data: bytes) -> tuple[list[str], np.ndarray]:
    """Words and unit vectors of a binary model: ``size SP dim NL``, then ``word SP float32[dim]`` each."""
    head, newline, _ = data.partition(b"\n")
    if not newline or len(head.split(b" ")) != 2:
        raise ValueError("malformatted model header")
    n, dim = map(int, head.split(b" "))
    at, words, vectors = len(head) + 1, [], np.zeros((n, dim))
    for i in range(n):
        end = data.find(b" ", at)
        if end < 0 or end + 1 + 4 * dim > len(data):
            raise ValueError("malformatted model row")
        words.append(data[at:end].lstrip(b"\n").decode())
        vectors[i] = np.frombuffer(data, dtype="<f4", count=dim, offset=end + 1)
        at = end + 1 + 4 * dim
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return words, vectors / norms


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, word, word_vec) of a binary model, rows at unit length."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                words, vectors = parse_word2vec(bytes(content))
                for k in range(0, len(words), 4096):
                    yield pd.DataFrame({"word_id": range(k, min(k + 4096, len(words))), "word": words[k : k + 4096], "word_vec": [v.astype("float32") for v in vectors[k : k + 4096]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word_id long, word string, word_vec array<float>")


def word2vec_bytes(words: list[str], vectors: np.ndarray) -> bytes:
    """The binary form of a small model (for tests and interchange)."""
    out = [f"{len(words)} {vectors.shape[1]}\n".encode()]
    for w, v in zip(words, vectors, strict=True):
        out.append(w.encode() + b" " + v.astype("<f4").tobytes() + b"\n")
    return b"".join(out)


def embedding_lines(df: DataFrame, vector: str, key: str, word: str | None = None) -> DataFrame:
    """(key, line): values separated, and ended, by a space; the word first where asked."""
    values = F.concat(F.array_join(F.transform(vector, lambda x: x.cast("string")), " "), F.lit(" "))
    return df.select(F.col(key), (F.concat(F.col(word), F.lit(" "), values) if word else values).alias("line"))


def write_embeddings(df: DataFrame, path: str, vector: str = "word_vec", key: str = "word_id", word: str | None = "word", dims: bool = False) -> None:
    """Text sink in id order; with ``dims`` the first line is ``size dim``."""
    rows = embedding_lines(df, vector, key, word)
    if dims:
        n = df.count()
        d = len(df.select(vector).first()[0]) if n else 0
        rows = rows.unionAll(df.sparkSession.createDataFrame([(-1, f"{n} {d}")], f"{key} long, line string"))
    rows.orderBy(key).select("line").write.mode("overwrite").text(path)


def save(path: str, meta: dict, **tables: DataFrame) -> None:
    """A model folder: a Parquet table for each part, and its settings."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, *names: str) -> tuple[dict, dict[str, DataFrame]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return meta, {n: spark.read.parquet(f"{path}/{n}") for n in names}
