"""Token streams and exact vocabularies (FIXTURES F1, F2, F10)."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.operators import vocab
from wordloom.sources import text

A = "foo bar foo baz baz bbq baz"
B = A + " baz bbq foo foo"
C = "bbq bar foo foo baz baz baz bbq foo foo foo baz"
D = "bbq bar foo foo baz baz baz bbq foo foo foo bbq"


def stream(spark, words):
    return spark.createDataFrame([(i, w) for i, w in enumerate(words.split())], "pos long, word string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sents(spark, s, **k):
    rows = text.sentences(docs(spark, s), ["doc_id"], **k).orderBy("line_no", "chunk").collect()
    return [r["ws"] for r in rows]


def test_tokenizer_cases(spark):
    assert sents(spark, "a b\n") == [["a", "b"]]
    assert sents(spark, "a\rb c\n") == [["ab", "c"]]
    assert sents(spark, "a\t\t b\n\nc\n") == [["a", "b"], [], ["c"]]
    assert sents(spark, "a b c\n", limit=2) == [["a", "b"], ["c"]]
    assert sents(spark, "a b\nc\n", limit=2) == [["a", "b"], ["c"]]
    assert sents(spark, "a b") == [["a", "b"]]
    assert sents(spark, "a b", drop_unterminated=True) == [["a"]]
    assert sents(spark, "") == [] and sents(spark, "  \t") == [] and sents(spark, "\n") == [[]]


def test_tokens_null_and_empty(spark):
    rows = text.tokens(docs(spark, None, "", " x "), ["doc_id"]).collect()
    assert [tuple(r) for r in rows] == [(2, 1, 1, "x")]


def test_first_seen_ids(spark):
    rows = vocab.first_seen(stream(spark, A), "pos").orderBy("word_id").collect()
    assert [tuple(r) for r in rows] == [(0, "foo", 2), (1, "bar", 1), (2, "baz", 3), (3, "bbq", 1)]


def test_ordered_counts(spark):
    rows = vocab.ordered_counts(vocab.counts(stream(spark, B))).orderBy("rank").collect()
    assert [r["count"] for r in rows] == [4, 4, 2, 1]


@pytest.mark.parametrize(("words", "n", "want", "total"), [(C, 5, ["foo", "baz", "bbq", "bar"], 12), (C, 4, ["foo", "baz", "bbq", "bar"], 12), (C, 2, ["foo", "baz"], 9), (D, 3, ["foo", "baz", "bbq"], 11)])
def test_truncate(spark, words, n, want, total):
    v = vocab.exact_lm(stream(spark, words), n)
    assert [r["word"] for r in v.orderBy("word_id").collect()] == want
    assert tuple(vocab.summary(v, n).first()) == (len(want), total, n)


def test_lookup_and_reverse(spark):
    v = vocab.exact_lm(stream(spark, A), 2)
    got = {r["word"]: r["word_id"] for r in vocab.lookup(stream(spark, A), v).collect()}
    assert got == {"foo": 1, "baz": 0, "bar": -1, "bbq": -1}
    back = vocab.reverse_lookup(v.select("word_id"), v).collect()
    assert {(r["word_id"], r["word"], r["count"]) for r in back} == {(0, "baz", 3), (1, "foo", 2)}


def test_lookup_without_bound_joins_by_shuffle(spark):
    v = vocab.exact_lm(stream(spark, A), 2)
    assert vocab.lookup(stream(spark, A), v, size=None).where("word_id >= 0").count() == 5


def test_keep_probability(spark):
    df = spark.createDataFrame([(2,), (3,)], "count long")
    p = [r[0] for r in df.select(vocab.keep_probability(F.col("count"), F.lit(7), 1 / 7)).collect()]
    assert p == pytest.approx([math.sqrt(1 / 2), math.sqrt(1 / 3)])
    p = [r[0] for r in df.select(vocab.keep_probability(F.col("count"), F.lit(7), 2.5 / 7)).collect()]
    assert p == pytest.approx([1.0, math.sqrt(2.5 / 3)])


def test_subsample_rate(spark):
    x = spark.range(20_000).select(F.col("id").alias("pos"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("word"))
    v = vocab.exact_lm(x, 10)
    kept = {r["word"]: r["count"] for r in vocab.subsample(x, v, 20_000, ["pos"], 0.25).groupBy("word").count().collect()}
    assert kept["b"] == 5000 and abs(kept["a"] / 15_000 - math.sqrt(0.25 / 0.75)) < 0.03


def test_vocab_file(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("foo 3\nbar 2\nfoo 1\n")
    v = vocab.from_counts(text.vocab_file(spark, str(p)))
    assert [tuple(r) for r in v.orderBy("word_id").collect()] == [(0, "foo", 4), (1, "bar", 2)]
    p.write_text("foo three\n")
    with pytest.raises(Exception, match="malformatted vocabulary"):
        text.vocab_file(spark, str(p)).collect()
    with pytest.raises(OSError, match="cannot be read"):
        text.vocab_file(spark, str(tmp_path / "none"))


def test_vocab_text_sink(spark, tmp_path):
    text.write_vocab(vocab.exact_lm(stream(spark, A), 2), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["baz 3", "foo 2"]
