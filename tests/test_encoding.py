"""Encoding in place, strict lookups, resumed training and a caller's own sampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import sgns, vocab
from wordloom.operators.protocols import NegativeSampler
from wordloom.sources import text

DOCS = [(1, "a b a c\n\nb  zz a"), (2, None), (3, ""), (4, "zz yy"), (5, " ".join(["a", "b", "c"] * 900)), (6, "a\r b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(0, "a", 904), (1, "b", 903), (2, "c", 901)], "word_id long, word string, count long")


def rows(df, *key):
    return {tuple(r[k] for k in key): list(r["ids"]) for r in df.collect()}


def test_in_place_equals_join(docs, words):
    joined = vocab.encode_sentences(vocab.in_vocabulary(text.tokens(docs, ["doc_id"]), words), ["doc_id", "line_no"])
    in_place = vocab.encode_in_place(text.lines(docs, ["doc_id"]), words, ["doc_id", "line_no"])
    assert rows(in_place, "doc_id", "line_no") == rows(joined, "doc_id", "line_no")
    assert vocab.encode_in_place(text.lines(docs, ["doc_id"]), words.limit(0), ["doc_id", "line_no"]).count() == 0


def test_sentences_are_cut_at_the_limit(docs, words):
    got = rows(vocab.encode_in_place(text.sentences(docs, ["doc_id"]), words, ["doc_id", "line_no", "chunk"]), "doc_id", "line_no", "chunk")
    assert [len(got[5, 1, k]) for k in range(3)] == [1000, 1000, 700] and sum((got[5, 1, k] for k in range(3)), []) == [0, 1, 2] * 900


def test_subsampling_in_place(docs, words):
    sentences = text.sentences(docs, ["doc_id"])
    draw = lambda x: rows(vocab.encode_in_place(x, words, ["doc_id", "line_no", "chunk"], 2708, 0.05), "doc_id", "line_no", "chunk")
    once = draw(sentences)
    assert once == draw(sentences.repartition(3))
    kept, all_ = np.bincount(sum(once.values(), []), minlength=3), np.array([904, 903, 901])
    assert np.abs(kept / all_ - np.sqrt(0.05 * 2708 / all_)).max() < 0.05


def test_strict_reverse_lookup(spark, words):
    ids = spark.createDataFrame([(0,), (2,)], "word_id long")
    assert sorted(map(tuple, vocab.reverse_lookup(ids, words, strict=True).select("word_id", "word", "count").collect())) == [(0, "a", 904), (2, "c", 901)]
    with pytest.raises(Exception, match="unknown word id: 7"):
        vocab.reverse_lookup(ids.unionAll(spark.createDataFrame([(7,)], "word_id long")), words, strict=True).collect()


def test_training_resumes(docs, words):
    sentences = vocab.encode_in_place(text.sentences(docs, ["doc_id"]), words, ["doc_id", "line_no", "chunk"])
    order = ("doc_id", "line_no", "chunk")
    once = sgns.train(sentences, words, dim=8, exact=True, order=order)
    again = sgns.train(sentences, words, dim=8, exact=True, order=order, resume=once)
    steps = lambda m: {r["word"]: r["steps"] for r in m.collect()}
    assert steps(once) == {"a": 904, "b": 903, "c": 901} and steps(again) == {w: 2 * n for w, n in steps(once).items()}
    start = {r["word"]: np.array(r["word_vec"]) for r in once.collect()}
    nothing = sgns.train(sentences.limit(0), words, dim=8, resume=once)
    assert all((start[r["word"]] == np.array(r["word_vec"])).all() for r in nothing.collect())


class First:
    def sample(self, rng, n):
        return np.zeros(n, dtype=np.int64)

    def step(self):
        pass


def test_a_sampler_of_the_caller(docs, words):
    assert isinstance(First(), NegativeSampler)
    sentences = vocab.encode_in_place(text.sentences(docs, ["doc_id"]), words, ["doc_id", "line_no", "chunk"]).where(F.size("ids") < 5)
    for exact in (True, False):
        m = {r["word"]: r for r in sgns.train(sentences, words, dim=4, exact=exact, order=("doc_id", "line_no"), sampler=First()).collect()}
        assert any(m["a"]["context_vec"]) and len(m) == 3
