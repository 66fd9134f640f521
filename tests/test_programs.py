"""The programs, from text files to printed models."""

import pytest

from wordloom import __main__ as cli


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("foo bar foo baz baz bbq baz\nbaz bbq foo foo\n" * 5)
    return tmp_path


def run(*args):
    cli.main([str(a) for a in args])


def lines(spark, path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_vocabularies(spark, corpus):
    run("naive-lm-train", corpus / "in", corpus / "lm", "-v", 2)
    run("naive-lm-print", corpus / "lm", corpus / "txt", "-c")
    assert lines(spark, corpus / "txt") == ["baz 20", "foo 20"]
    run("spacesaving-lm-train", corpus / "in", corpus / "ss", "-v", 10)
    run("spacesaving-lm-print", corpus / "ss", corpus / "ss.txt")
    assert lines(spark, corpus / "ss.txt") == ["foo", "bar", "baz", "bbq"]
    (corpus / "v.txt").write_text("foo 3\nbar 2\n")
    run("word2vec-vocab-to-naive-lm", corpus / "v.txt", corpus / "lm2")
    run("naive-lm-print", corpus / "lm2", corpus / "txt2", "-c")
    assert lines(spark, corpus / "txt2") == ["foo 3", "bar 2"]


def test_embeddings(spark, corpus):
    run("naive-lm-train", corpus / "in", corpus / "lm")
    for name, more in (("word2vec-train", ["-l", corpus / "lm"]), ("word2vec-alias-train", ["--exact"])):
        run(name, corpus / "in", corpus / name, "-e", 4, "-s", 1.0, *more)
        run("word2vec-print", corpus / name, corpus / f"{name}.txt", "-w", "-d")
        out = lines(spark, corpus / f"{name}.txt")
        assert out[0] == "4 4" and out[1].startswith("baz ") and all(len(x.split()) == 5 for x in out[1:])
    run("spacesaving-word2vec-train", corpus / "in", corpus / "one", "-v", 3, "-e", 4)
    run("spacesaving-word2vec-print", corpus / "one", corpus / "one.txt")
    assert len(lines(spark, corpus / "one.txt")) == 3
