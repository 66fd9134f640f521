"""Neighbours scored in blocks: the same as in one dense matrix, ties, repeats and odd vectors included, in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wordloom.functions.numeric import fast_sigmoid_array
from wordloom.operators import similarity


@pytest.fixture
def scorers(monkeypatch, spark):
    """(prepare, best_of) of both queries."""
    found = {}
    monkeypatch.setattr(similarity, "_scan", lambda have, asked, chunk, prepare, best_of, name, value: found.setdefault(name, (prepare, best_of)))
    v = spark.createDataFrame([(0, [1.0], [1.0])], "word_id long, word_vec array<float>, context_vec array<float>")
    similarity.nearest_neighbor(v)
    similarity.context_nearest_neighbor(v, spark.createDataFrame([(0, [0])], "context_id long, ids array<long>"))
    return found


def vectors(n, d, scale=1.0):
    x = np.random.default_rng(n + d).normal(size=(n, d)).astype(np.float32).astype(float) * scale
    x[n // 2 : n // 2 + 9] = x[3]
    x[-1], x[-2] = 0, x[5] * 2
    return x


@pytest.mark.parametrize("scale", [1e-3, 0.3, 3, 1e5])
def test_scores_equal_the_dense_ones(scorers, scale):
    x = vectors(700, 12, scale)
    if scale == 3:
        x[11, 0] = np.nan
    ids = np.arange(700) * 3
    with np.errstate(invalid="ignore", divide="ignore"):
        n = np.sqrt((x * x).sum(1))
        s = np.round(x @ x.T / np.outer(n, n), 12)
    s[np.isnan(s) | np.eye(700, dtype=bool)] = -np.inf
    prepare, best_of = scorers["query_id"]
    top, at = best_of(ids, prepare(pa.table({"v": pa.array(x.tolist())})), ids, x)
    assert np.allclose(top, s.max(axis=1)) and (at == s.argmax(axis=1)).all()

    sizes = np.random.default_rng(2).integers(0, 4, 300)
    sizes[7] = 600  # a context longer than a block
    ends, rows = np.concatenate([[0], np.cumsum(sizes)]), x[np.random.default_rng(3).integers(12, 700, sizes.sum())]
    want = np.array([np.round(fast_sigmoid_array(np.nan_to_num(rows[a:b] @ x.T)).sum(axis=0), 12) if a < b else np.zeros(700) for a, b in zip(ends, ends[1:])])
    if scale == 3:
        want[sizes > 0, 11] = -np.inf
    top, at = scorers["context_id"][1](np.arange(300), (rows, ends), ids, x)
    assert np.allclose(top, want.max(axis=1)) and (at == want.argmax(axis=1)).mean() > 0.99 and np.allclose(want[np.arange(300), at], want.max(axis=1))


def test_memory_is_bounded(scorers):
    x = vectors(2048, 64)
    y = np.concatenate([x, x + 0.1])
    for name in scorers:
        prepare, best_of = scorers[name]
        queries = prepare(pa.table({"v": pa.array(y.tolist())})) if name == "query_id" else (y, np.arange(len(y) + 1))
        tracemalloc.start()
        best_of(np.arange(len(y)), queries, np.arange(2048), x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6  # one dense matrix has 67 MB
