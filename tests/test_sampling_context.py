"""Noise, samplers and contexts (FIXTURES F3, F4, F5, F8)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import context, sampling


def probs(spark, p):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, p double")


def test_normalize(spark):
    df = spark.createDataFrame([(0, 7), (1, 0), (2, 12)], "word_id long, count long")
    got = [r["p"] for r in sampling.normalize(df, exponent=0.8, offset=4.2).orderBy("word_id").collect()]
    raw = (np.array([7, 0, 12]) + 4.2) ** 0.8
    assert got == pytest.approx(raw / raw.sum())
    zero = spark.createDataFrame([(0, 0)], "word_id long, count long")
    assert sampling.normalize(zero).first()["p"] is None


@pytest.mark.parametrize(("p", "want"), [([0.1, 0.5, 0.4], [1, 5, 3]), ([0.1, 0.2, 0.1], [1, 2, 6]), ([0.1, 0.001, 0.899], [1, 1, 7]), ([1.0], [9])])
def test_slots(spark, p, want):
    rows = sampling.slots(probs(spark, p), 9).orderBy("id").collect()
    assert [r["end"] - r["start"] for r in rows] == want == sampling.slot_counts(p, 9)
    assert sampling.slot_counts([], 9) == []


def test_cumulative_draws(spark):
    draws = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (0.6,), (0.95,), (1.0,)], "u double")
    got = [r["id"] for r in sampling.draw_cumulative(probs(spark, [0.1, 0.5, 0.4]), draws, "id").collect()]
    assert got == [0, 0, 1, 1, 2, 2]
    rows = sampling.cumulative(probs(spark, [0.1, 0.5, 0.4]), "id").orderBy("id").collect()
    assert [r["high"] for r in rows] == pytest.approx([0.1, 0.6, 1.0]) and [r["low"] for r in rows] == pytest.approx([0, 0.1, 0.6])
    with pytest.raises(ValueError):
        sampling.draw_cumulative(probs(spark, []), draws, "id")


@given(st.lists(st.floats(0, 1), min_size=1, max_size=40).filter(lambda p: sum(p) > 1e-3))
@settings(max_examples=60, deadline=None)
def test_alias_is_exact(p):
    q = np.array(p) / sum(p)
    assert sampling.alias_implied(*sampling.alias_table(q)) == pytest.approx(q, abs=1e-9)


def test_alias_draws():
    p = np.array([0.6, 0, 0.4, 0])
    rng = np.random.default_rng(0)
    x = sampling.alias_draw(*sampling.alias_table(p), rng.random(100_000), rng.random(100_000))
    assert np.bincount(x, minlength=4) / 1e5 == pytest.approx(p, abs=6 * 0.5 / 1e5**0.5)
    with pytest.raises(ValueError):
        sampling.alias_table(np.array([]))


def test_refresh_schedule():
    s = sampling.EmpiricalSampler(lambda: [2, 2, 3], interval=5, burn_in=2, offset=2.33)
    for _ in range(14):
        s.step()
    assert s.refreshed == [1, 2, 7, 12]
    never = sampling.EmpiricalSampler(lambda: [1], interval=0)
    for _ in range(5):
        never.step()
    assert never.refreshed == [1]


def test_reservoir_weights():
    values = [-1] * 8 + [7] * 4 + [3] * 2 + [0]
    hits = {v: 0 for v in values}
    rng = np.random.default_rng(1)
    n = 6000
    for _ in range(n):
        r = sampling.Reservoir(3, rng)
        for v in values:
            r.insert(v)
        hits[r.sample()] += 1
    for v, w in ((-1, 8), (7, 4), (3, 2), (0, 1)):
        p = w / 15
        assert abs(hits[v] / n - p) < 6 * (p * (1 - p) / n) ** 0.5
    r.clear()
    with pytest.raises(ValueError):
        r.sample()
    assert r.insert(5) == 5


def test_reservoir_rows_are_stable(spark):
    df = spark.range(1000)
    a = {r[0] for r in sampling.reservoir(df, 10, "id").collect()}
    assert a == {r[0] for r in sampling.reservoir(df.repartition(7), 10, "id").collect()} and len(a) == 10


def test_uniform_needs_words():
    with pytest.raises(ValueError):
        sampling.uniform_id(0, "u")


def test_static_and_dynamic_sizes(spark):
    df = spark.createDataFrame([(i, j) for i in range(5) for j in range(5)], "l int, r int")
    for r in df.select("l", "r", *context.static_size(F.col("l"), F.col("r"), 3)).collect():
        assert (r[2], r[3]) == (min(3, r[0]), min(3, r[1]))
    reach = [r[0] for r in spark.range(3000).select(context.dynamic_reach(3, "x", F.col("id"))).collect()]
    assert set(reach) == {1, 2, 3} and all(abs(reach.count(k) / 3000 - 1 / 3) < 0.06 for k in (1, 2, 3))


def test_pairs_in_order(spark):
    df = spark.createDataFrame([(0, [0, 2, 1]), (1, [7]), (2, [])], "s long, ids array<long>")
    got = [(r["target"], r["context"]) for r in context.pairs(df, ["s"], c=5).collect()]
    assert got == [(0, 2), (0, 1), (2, 0), (2, 1), (1, 0), (1, 2)]


def test_oov_windows(spark):
    ids = [0, 1, 1, 2, -1, 1, 2, 1, 2]
    df = spark.createDataFrame([(i, ids[i : i + 4]) for i in range(6)], "i long, ids array<long>")
    assert [r[0] for r in df.orderBy("i").select(context.has_oov("ids")).collect()] == [False, True, True, True, True, False]
