"""Pairs of words: one draw for each centre, no window without words."""

from wordloom.operators import context


def test_one_draw_for_a_centre(spark):
    x = spark.createDataFrame([(1, [5, 6, 7]), (2, [8]), (3, [])], "doc_id long, ids array<long>")
    got = context.pairs(x, ["doc_id"], c=1, dynamic="w")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5, 6), (1, 2, 6, 5), (1, 2, 6, 7), (1, 3, 7, 6)]
