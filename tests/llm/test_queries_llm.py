"""The registered queries and the pipeline at the smallest size."""

import hashlib
import os
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from wordloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in sorted(os.listdir(DATA)):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    df = entry.queries()[name](spark, DATA)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, got.fetchall()))


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_packing_query_matches_the_library(spark):
    library = Tokenizer.from_file(queries._vocabulary("word_bpe_49k.json"))
    rows, at, sequences = queries.op1_packing(spark, DATA).collect(), {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        at.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts_of(spark).items():
        ids, done = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for r in at[i]:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"], len(own)) == (done, len(ids), r["length"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            done += r["length"]
        assert done == len(ids)
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:k]) for k in range(len(rs))] and sum(r["length"] for r in rs) <= 2048


def test_bpe_query_matches_the_library(spark):
    library, texts = Tokenizer.from_file(queries._vocabulary("byte_bpe_50k.json")), texts_of(spark)
    for r in queries.op7_bpe(spark, DATA).collect():
        ids = library.encode(texts.pop(r["doc_id"]), add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert not texts


def test_sharding_query(spark):
    texts, rows = texts_of(spark), queries.op8_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    slots = {}
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body)) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_query(spark):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert sum(held) >= 0.98 * len(held) > 0


def test_pipeline(spark):
    from tests.llm.test_text_ops import brute_classes, brute_lines, check_packing
    from wordloom.llm import packing

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "packing"]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in out.collect()}
        out = stage(spark, out, DATA).persist()
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            assert set(before) == set(after)  # all these have a language
        elif name == "line_dedup":
            ids = sorted(before)
            want = brute_lines([before[i]["text"] for i in ids], 10)
            assert {i: after[i]["text"] for i in ids} == {i: w[2] for i, w in zip(ids, want, strict=True)}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        else:
            ids = sorted(before)
            want = brute_classes([before[i]["text"] for i in ids], 5, 80)
            assert set(after) == {i for k, i in enumerate(ids) if want[k][1] == k}
    library = Tokenizer.from_file(queries._vocabulary("word_bpe_49k.json"))
    rows = packing.pack(out, queries._vocabulary("word_bpe_49k.json")).collect()
    check_packing(rows, {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in out.collect()})
    assert corpus_pipeline.run(spark, DATA).count() == len(rows)


def odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    english = "the river runs past the old mill and the people of the village walk along it in the evening light"
    rows = [(1, english, "en"), (1, english, "en"), (2, english, "en"), (3, None, "en"), (4, "", None), (5, long, None), (6, "der fluss und die alte stadt am abend", "de"), (None, english, "en"), (7, "x\n" * 50, None), (8, "  \t", "en")]
    df = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("score", "lang_pred", "n_lines", "n_dropped", "_id", "_key", "_kept", "_text", "_whole", "_drops", "row", "root", "token", "c", "id", "k")
    return df.withColumns({n: F.lit(n) for n in names})


def test_pipeline_on_odd_documents(spark):
    docs = odd_documents(spark)
    one = corpus_pipeline.language_id(spark, docs, DATA)
    assert one.columns == docs.columns and {r["score"] for r in one.collect()} == {"score"}
    assert {3, 4, 8}.isdisjoint(r["doc_id"] for r in one.collect()) and {1, 2, 6}.issubset({r["doc_id"] for r in one.collect()})
    two = corpus_pipeline.lines(spark, docs, DATA)
    assert two.columns == docs.columns and two.count() == docs.count() and {r["n_lines"] for r in two.collect()} == {"n_lines"}
    three = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert three.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in three.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None"])
    four = corpus_pipeline.packed(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in four} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_empty_tables(spark):
    docs = odd_documents(spark)
    for some in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, DATA).columns == docs.columns
        assert corpus_pipeline.language_id(spark, some, DATA).count() == some.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
