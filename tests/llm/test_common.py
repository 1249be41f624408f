import pytest

from pixelloom.llm import common as C


@pytest.mark.parametrize("least", [5, 10_000])
def test_even_join_is_a_join(spark, monkeypatch, least):
    """Hot keys, keys that only one side has, null keys: the rows of a plain join, either way."""
    monkeypatch.setattr(C, "LEAST_HOT", least)
    big = spark.createDataFrame([(k, 1 if k % 3 else None if k % 2 else k % 17) for k in range(400)], "n int, key int")
    small = spark.createDataFrame([(k, f"v{k}") for k in (0, 1, 2, 5, 99)], "key int, v string")
    for how in ("inner", "left"):
        want = big.join(small, "key", how)
        got = C.even_join(big, small, "key", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_keys_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_HOT", 50)
    big = spark.createDataFrame([(k, 0 if k < 300 else k) for k in range(400)], "n int, key int")
    small = spark.createDataFrame([(k, k) for k in range(400)], "key int, v int")
    plan = C.even_join(big, small, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and plan.count("SortMergeJoin") == 1


def test_wide_hot_rows_are_salted(spark, monkeypatch):
    """Rows of many bytes aren't broadcast however few there are; the join is the same."""
    monkeypatch.setattr(C, "LEAST_HOT", 50)
    big = spark.createDataFrame([(k, 0 if k < 300 else None if k % 7 == 0 else k) for k in range(400)], "n int, key int")
    small = spark.createDataFrame([(k, "v" * 100, k) for k in range(0, 400, 2)], "key int, v string, salt int")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "key", how).collect()))
        for most in (C.HOT_BYTES, 50):
            monkeypatch.setattr(C, "HOT_BYTES", most)
            got = C.even_join(big, small, "key", how, wide=True)
            assert sorted(map(str, got.select("key", "n", "v", "salt").collect())) == want
            plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert (plan.count("SortMergeJoin") == 2) == (most == 50)
        monkeypatch.undo()
        monkeypatch.setattr(C, "LEAST_HOT", 50)


def test_unused_names():
    assert C.unused("a", ["b"]) == "a" and C.unused("a", ["A", "a_"]) == "a__"


def test_scratch_steps_go_and_lasting_ones_stay(spark):
    df = spark.range(10)
    with C.scratch():
        gone, stays = C.saved(df, "gone"), C.saved(df, "stays", lasting=True)
        assert gone.count() == stays.count() == 10
    assert spark.read.parquet(stays.saved_at).count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone.saved_at)
