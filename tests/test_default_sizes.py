"""The registered sketches and trainers have the reference's default sizes."""

import pytest

import __spark_entry__ as entry
from wordloom.operators.sgns import DIM
from wordloom.operators.vocab import VOCABULARY

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["spacesaving_topk", "spacesaving_merged", "spacesaving_streaming"])
def test_counters(spark, name):
    words = entry.queries()["vocab_counts"](spark, DATA).count()
    assert entry.queries()[name](spark, DATA).count() == min(words, VOCABULARY) > 2000


@pytest.mark.parametrize("name", ["sgns_train", "sgns_train_alias", "sgns_stream"])
def test_dimensions(spark, name):
    rows = entry.queries()[name](spark, DATA).select("word_vec").collect()
    assert {len(r["word_vec"]) for r in rows} == {DIM} and len(rows) > 2000
