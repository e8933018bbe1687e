"""Stores with several writers: nothing is lost, only touched buckets are written."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from linkloom.operators import state, store


def aliases(spark, *keys):
    return spark.createDataFrame([("team", s, t, "football", 1, 0.5, 10, "learned") for s, t in keys], state.COLUMNS)


def held(s):
    return {(r["src_id"], r["ts_id"]): r["votes"] for r in s.read().collect()}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers merge at the same time, into the same and into other buckets."""
    path = f"file://{tmp_path}/aliases"
    work = [aliases(spark, ("a", "x"), (f"own{i}", "y")) for i in range(6)]
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda rows: state.learn(state.alias_store(spark, path), rows), work))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert held(state.alias_store(spark, path)) == {("a", "x"): 6, **{(f"own{i}", "y"): 1 for i in range(6)}}


def test_write_on_an_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/aliases"
    one, two = state.alias_store(spark, path), state.alias_store(spark, path)
    one.read()
    two.read()
    assert one.write(aliases(spark, ("a", "x"))) == 1
    with pytest.raises(store.Conflict):
        two.write(aliases(spark, ("b", "y")))
    assert held(two) == {("a", "x"): 1}
    assert two.write(aliases(spark, ("b", "y"))) == 2
    assert held(one) == {("b", "y"): 1}


def test_other_buckets_stay(spark, tmp_path):
    s = state.alias_store(spark, f"file://{tmp_path}/aliases")
    state.learn(s, aliases(spark, *[(f"s{i}", "t") for i in range(200)]))
    before = s._manifest(1)
    state.learn(s, aliases(spark, ("s5", "t"), ("s5", "u")))
    after = s._manifest(2)
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert held(s)[("s5", "t")] == 2 and held(s)[("s5", "u")] == 1 and len(held(s)) == 201


def test_nothing_to_merge(spark, tmp_path):
    s = state.alias_store(spark, f"file://{tmp_path}/aliases")
    assert state.learn(s, aliases(spark).limit(0)) == 0 and held(s) == {}


def test_stats(spark):
    rows = aliases(spark, ("a", "x"), ("b", "y")).unionByName(aliases(spark, ("c", "z")).selectExpr("side", "src_id", "ts_id", "'tennis' as sport", "3L as votes", "confidence", "last_seen", "origin"))
    assert {r["sport"]: (r["n"], r["votes"], r["trusted"]) for r in state.store_stats(rows).collect()} == {"football": (2, 2, 0), "tennis": (1, 3, 1)}
