"""The ``_full`` queries keep the default vocabulary, with words beyond the thousand that their namesakes keep."""

import pytest

import __spark_entry__ as entry
from wordloom.operators.vocab import VOCABULARY
from wordloom.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["encoded_sentences", "skipgram_pairs_static", "skipgram_pairs_dynamic", "pair_counts_topk", "context_has_oov", "oov_rate_by_source", "reverse_lookup"])
def test_registered_with_sql(name):
    assert f"{name}_full" in entry.queries() and f"{name}_full" in core.SQL


def test_every_id(spark):
    run = lambda name: entry.queries()[name](spark, DATA)
    words = {r["word_id"]: r["word"] for r in run("vocab_topk_ids").collect()}
    assert {r["word_id"]: r["word"] for r in run("reverse_lookup_full").collect()} == words and len(words) == VOCABULARY
    assert {int(i) for r in run("encoded_sentences_full").collect() for i in r["ids_text"].split()} == set(words)
    assert run("skipgram_pairs_static_full").agg({"target": "max"}).first()[0] == VOCABULARY - 1
