"""Every registered query of the core agrees with its SQL at the smallest size; the entry runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.plans import queries as core

DATA = "/root/testdata/sf0.001"
#: Streams and trainers have tests of their own.
SLOW = {"sgns_train", "sgns_train_alias", "sgns_stream", "spacesaving_streaming"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def flat(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    put = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(put(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(core.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want, mine = flat(got.fetchall(), names), flat([tuple(r) for r in df.collect()], df.columns)
    assert mine == want and mine


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word_id", "word", "count"] and df.count() == 16_000
