import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling as S
from corpusloom.operators import selection as L


def by_sort(df, n, digest):
    """The rows that a plain sort gives, as a multiset of digests."""
    return sorted(r.d or "" for r in df.select(digest.alias("d")).collect())[:n]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.col("id").cast("long").alias("id"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).alias("v")).repartition(5)


@pytest.mark.parametrize("n, settle", [(0, 1), (1, 10_000), (999, 1), (999, 10_000), (2999, 100), (3000, 1), (5000, 1)])
def test_smallest_equals_a_sort(spark, rows, monkeypatch, n, settle):
    monkeypatch.setattr(L, "SETTLE", settle)
    digest = S.md5_key(42, "id", "sample:")
    got = L.smallest(rows, n, digest)
    assert got.columns == rows.columns
    assert sorted(r.d for r in got.select(digest.alias("d")).collect()) == by_sort(rows, n, digest)


def test_groups_have_their_own_limits(spark, rows):
    digest = S.md5_key(1, "id")
    got = L.side_of_limit(rows, digest, {("0",): 10, ("1",): 2000, ("2",): 0, ("x",): 5}, ("g",)).where("_in")
    want = by_sort(rows.where("g = '0'"), 10, digest) + by_sort(rows.where("g = '1'"), 2000, digest)
    assert sorted(r.d for r in got.select(digest.alias("d")).collect()) == sorted(want)


@pytest.mark.parametrize("settle", [1, 10_000])
def test_repeated_and_null_ids_are_split_row_by_row(spark, monkeypatch, settle):
    monkeypatch.setattr(L, "SETTLE", settle)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (1, "a")] + [(7, str(i)) for i in range(40)], "id long, x string")
    whole = sorted(map(str, df.collect()))
    for n in (1, 3, 4, 20, 45):
        got = L.smallest(df, n, S.md5_key(42, "id"))
        assert got.count() == min(n, 45)
    for ratio in (0.05, 0.3):
        split = S.train_eval_split_exact(df, "id", ratio)
        assert sorted(map(str, split.select("id", "x").collect())) == whole
        assert split.where("split = 'eval'").count() == math.ceil(45 * ratio)
    same = [sorted(map(str, S.train_eval_split_exact(df.repartition(k), "id", 0.3).collect())) for k in (1, 4)]
    assert same[0] == same[1]


def test_no_sort_no_join_no_single_task(spark, rows):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (S.sample_rows(rows, 100, "id"), S.train_eval_split_exact(rows, "id", 0.1)):
        own = plan(df)
        assert not any(x in own for x in ("Join", "Window", "TakeOrdered", "GlobalLimit", "SinglePartition")), own
    assert L.smallest(rows.limit(0), 5, S.md5_key(1, "id")).count() == 0
