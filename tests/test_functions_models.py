"""Vector functions, model files, similarity and training arithmetic (FIXTURES F6, F7, F9)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import numeric as N
from wordloom.operators import protocols, sampling, sgns, similarity, sketch
from wordloom.sources import models

X, Y = [0.5, -1.0, -2.0], [-5.0, 0.0, -3.0]
WORD = [[0.1, -0.2], [-0.3, 0.2], [0.4, 0.0]]
CTX = [[0.4, 0.0], [-0.3, 0.2], [0.1, -0.2]]


def one(spark, expr):
    return spark.createDataFrame([(X, Y)], "x array<float>, y array<float>").select(expr).first()[0]


def test_kernels(spark):
    assert one(spark, N.dot("x", "y")) == pytest.approx(3.5)
    assert one(spark, N.norm("x")) == pytest.approx(2.291288, abs=1e-6)
    assert one(spark, N.axpy(7.0, "x", "y")) == pytest.approx([-1.5, -7, -17])
    assert one(spark, N.scal(7.0, "x")) == pytest.approx([3.5, -7, -14])
    assert one(spark, N.axpy(7.0, "x", "y", 2)) == pytest.approx([-1.5, 0, -17])
    assert one(spark, N.scal(7.0, "x", 2)) == pytest.approx([3.5, -1, -14])
    assert one(spark, N.strided("x", 2)) == pytest.approx([0.5, -2])


def test_near(spark):
    df = spark.createDataFrame([(1.0, 1.00005, 1.0002, [1.0], [1.0, 2.0])], "a double, b double, c double, v array<double>, w array<double>")
    r = df.select(N.near("a", "b"), N.near("a", "c"), N.near_vectors("v", "v"), N.near_vectors("v", "w")).first()
    assert tuple(r) == (True, False, True, False)


def test_sigmoids(spark):
    df = spark.createDataFrame([(x,) for x in (2.0, -2.0, 11.5, -11.5, 0.0, 3.3)], "x double")
    rows = df.select("x", N.sigmoid("x"), N.fast_sigmoid("x"), N.fast_sigmoid("x", 100_000)).collect()
    for x, s, f, fine in rows:
        exact = 1.0 if x > 11 else 0.0 if x < -11 else 1 / (1 + np.exp(-x))
        assert s == pytest.approx(exact, abs=1e-9) and abs(f - exact) < 1e-2 and abs(fine - exact) < 1e-4
        assert float(N.fast_sigmoid_array(np.array([x]))[0]) == pytest.approx(f, abs=1e-12)
    assert rows[4][2] == pytest.approx(0.4972472, abs=1e-6)


def test_schedule(spark):
    s = sgns.Schedule(100, 0.5, 0.1, np.zeros(2, dtype=np.int64))
    assert s.rate(0) == 0.5
    for t, want in ((1, 0.495), (2, 0.49), (202, 0.1)):
        s.t[0] = t
        assert s.rate(0) == pytest.approx(want)
        assert spark.range(1).select(N.learning_rate(F.lit(t), 100, 0.5, 0.1)).first()[0] == pytest.approx(want)
    s.reset(0)
    assert s.rate(0) == 0.5
    with pytest.raises(ValueError):
        sgns.Schedule.new(2, 0)


def test_gradient_updates():
    g = np.array([-5.0, 0, -3])
    for t, alpha, want in ((1, 1, [-1.975, -1, -3.485]), (1, 2, [-4.45, -1, -4.97]), (2, 1, [-1.95, -1, -3.47]), (2, 2, [-4.4, -1, -4.94])):
        s, x = sgns.Schedule(100, 0.5, 0.1, np.array([t])), np.array(X)
        s.update(0, g, x, alpha)
        assert x == pytest.approx(want)


def test_protocols():
    assert isinstance(sketch.SpaceSaving(1), protocols.LanguageModel) and isinstance(sampling.EmpiricalSampler(lambda: [1]), protocols.NegativeSampler)
    assert isinstance(sgns.Schedule.new(1, 1), protocols.RateSchedule) and isinstance(sgns.dynamic_reach(np.random.default_rng(0)), protocols.ContextStrategy)


def model():
    return sgns.Model(np.array(WORD, np.float32), np.array(CTX, np.float32), sgns.Schedule(2, 0.5, 0.1, np.zeros(3, dtype=np.int64)))


@pytest.mark.parametrize(("case", "word", "ctx"), [
    ((2, 1, [0]), [WORD[0], WORD[1], [0.2133, 0.0530]], [[0.2929, 0], [-0.1940, 0.2], CTX[2]]),
    ((2, 1, [2]), [WORD[0], WORD[1], [0.2951, 0.1039]], [CTX[0], [-0.1940, 0.2], [-0.0017, -0.2]]),
    ((0, 1, [2, 1]), [[0.0626, -0.1328], WORD[1], WORD[2]], [CTX[0], [-0.2981, 0.1961], [0.0746, -0.1492]]),
])
def test_token_train(case, word, ctx):
    m = model()
    m.token_train(*case)
    assert m.word == pytest.approx(np.array(word), abs=1e-3) and m.context == pytest.approx(np.array(ctx), abs=1e-3)


def test_batch_train_of_one_pair_is_token_train():
    a, b = model(), model()
    a.token_train(2, 1, [0])
    b.batch_train(np.array([2]), np.array([1]), np.array([[0]]))
    assert a.word == pytest.approx(b.word, abs=1e-6) and a.context == pytest.approx(b.context, abs=1e-6)


def test_reset_word_and_sentence_steps():
    m = model()
    m.schedule.step([1, 1])
    m.reset_word(1, np.random.default_rng(0))
    assert m.schedule.t[1] == 0 and not m.context[1].any() and (abs(m.word[1]) <= 0.5).all()
    m.sentence_train([0, 2, 0], lambda left, right: (min(left, 5), min(right, 5)), lambda: [1])
    assert m.schedule.t.tolist() == [2, 0, 1]


def test_window_pairs_match_windows():
    rng = np.random.default_rng(3)
    sents = [np.arange(n) + 100 * n for n in (0, 1, 5, 9)]
    i, o = sgns.window_pairs(sents, rng, 1)
    want = {(int(s[a]), int(s[b])) for s in sents for a in range(len(s)) for b in (a - 1, a + 1) if 0 <= b < len(s)}
    assert set(zip(i.tolist(), o.tolist(), strict=True)) == want and len(i) == len(want)


def test_similarity(spark):
    v = spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(zip(WORD, CTX, strict=True))], "word_id long, word_vec array<float>, context_vec array<float>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.pair_similarity(pairs, v).collect()}
    assert got[0, 1] == pytest.approx(-0.8682431) and got[0, 2] == pytest.approx(0.4472136) and got[1, 2] == pytest.approx(-0.8320503)
    nn = {r["query_id"]: r["neighbor_id"] for r in similarity.nearest_neighbor(v).collect()}
    assert nn == {0: 2, 1: 2, 2: 0}
    contexts = {0: ([0], 2), 1: ([1], 1), 2: ([2], 0), 3: ([0, 0], 2), 4: ([0, 1], 2), 5: ([0, 2], 2), 6: ([1, 1], 1), 7: ([1, 2], 1), 8: ([2, 2], 0), 9: ([-1], 0), 10: ([], 0)}
    df = spark.createDataFrame([(k, ids) for k, (ids, _) in contexts.items()], "context_id long, ids array<long>")
    got = {r["context_id"]: r["neighbor_id"] for r in similarity.context_nearest_neighbor(v, df, chunk=2).collect()}
    assert got == {k: want for k, (_, want) in contexts.items()}


def test_nearest_neighbor_edges(spark):
    v = spark.createDataFrame([(5, [0.0, 0.0])], "word_id long, word_vec array<float>")
    assert [tuple(r) for r in similarity.nearest_neighbor(v).collect()] == [(5, -1, None)]
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])], "word_id long, word_vec array<float>")
    got = {r["query_id"]: r["neighbor_id"] for r in similarity.nearest_neighbor(v, chunk=2).collect()}
    assert got == {0: -1, 1: 2, 2: 1, 3: 1}


def test_word2vec_file(spark, tmp_path):
    data = models.word2vec_bytes(["foo", "bar"], np.array([[3, 4], [0, 2]]))
    (tmp_path / "m.bin").write_bytes(data)
    rows = models.read_word2vec(spark, str(tmp_path / "m.bin")).orderBy("word_id").collect()
    assert [(r["word"], list(r["word_vec"])) for r in rows] == [("foo", pytest.approx([0.6, 0.8])), ("bar", pytest.approx([0, 1]))]
    for bad in (b"2\n", b"2 2\nfoo ", b""):
        with pytest.raises(ValueError):
            models.parse_word2vec(bad)


def test_save_load_and_text(spark, tmp_path):
    m = sgns.frame(spark, ["a", "b"], sgns.Model(np.array([[1, 2], [3, 4]], np.float32), np.zeros((2, 2), np.float32), sgns.Schedule.new(2, 1)))
    models.save(str(tmp_path / "m"), {"dim": 2}, embedding=m)
    meta, t = models.load(spark, str(tmp_path / "m"), "embedding")
    assert meta == {"dim": 2} and sorted(map(str, t["embedding"].collect())) == sorted(map(str, m.collect()))
    models.write_embeddings(m, str(tmp_path / "t"), dims=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["2 2", "a 1.0 2.0 ", "b 3.0 4.0 "]


def test_training_learns(spark):
    rows = [([0, 1] * 4 if i % 2 else [2, 3] * 4,) for i in range(600)]
    s = spark.createDataFrame(rows, "ids array<long>").repartition(3)
    v = spark.createDataFrame([(i, w, 2400) for i, w in enumerate("abcd")], "word_id long, word string, count long")
    for settings in ({}, {"noise": "alias"}, {"exact": True}):
        m = sgns.train(s, v, dim=8, kappa=0.05, context=1, epochs=8, seed=5, batch=32, **settings).orderBy("word_id").collect()
        w, c = np.array([r["word_vec"] for r in m]), np.array([r["context_vec"] for r in m])
        fit = w @ c.T
        assert fit[0, 1] > fit[0, 3] and fit[2, 3] > fit[2, 1]
    with pytest.raises(ValueError):
        sgns.train(s, v.limit(0), dim=2)
