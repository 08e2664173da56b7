"""Splits are disjoint, covering, stable and, where promised, balanced."""

from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.stats import key_digest
from eventloom.operators import splits


@pytest.fixture(scope="module")
def events(spark):
    rare = F.when(F.col("id") % 50 == 0, 7).otherwise((F.col("id") % 3).cast("int"))
    return spark.range(4000).select(F.col("id").alias("rid"), rare.alias("CAMEOCode")).cache()


def keys(df):
    return [r["rid"] for r in df.collect()]


def test_holdout(events):
    train, test = splits.holdout_split(events, "rid", 0.2, 42)
    assert sorted(keys(train) + keys(test)) == list(range(4000))
    assert 700 < test.count() < 900
    again = splits.holdout_split(events.repartition(9), "rid", 0.2, 42)[1]
    other = splits.holdout_split(events, "rid", 0.2, 43)[1]
    assert sorted(keys(again)) == sorted(keys(test)) != sorted(keys(other))


def test_random_split_covers_by_weight(events):
    parts = splits.random_split(events, "rid", (5, 3, 2), seed=1)
    assert sorted(sum((keys(p) for p in parts), [])) == list(range(4000))
    assert [round(p.count() / 400) for p in parts] == [5, 3, 2]


@pytest.mark.parametrize("hot_rows", [10**6, 100])
def test_stratified_folds_are_balanced_per_class(events, hot_rows):
    folds = splits.stratified_folds(events, "rid", 3, seed=4, hot_rows=hot_rows)
    sizes = Counter((r["CAMEOCode"], r["fold"]) for r in folds.collect())
    assert sum(sizes.values()) == 4000
    for label in {label for label, _ in sizes}:
        of_label = [sizes[label, f] for f in range(3)]
        assert max(of_label) - min(of_label) <= 1
    plain = splits.stratified_folds(events, "rid", 3, seed=4)
    assert folds.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("few_rows", [256, 2])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_quantile_folds_equal_a_sort(events, k, few_rows):
    odd = events.withColumn("CAMEOCode", F.when(F.col("rid") == 11, 99).when(F.col("rid") % 400 != 3, F.col("CAMEOCode")))
    folds = splits.quantile_folds(odd, "rid", k, seed=4, few_rows=few_rows)
    by_digest = W.partitionBy("CAMEOCode").orderBy(key_digest("rid", 4), "rid")
    assert folds.exceptAll(odd.withColumn("fold", F.ntile(k).over(by_digest) - 1)).isEmpty()
    assert folds.count() == 4000
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMerge" not in plan


def test_quantile_folds_of_no_rows(events):
    assert splits.quantile_folds(events.limit(0), "rid", 3).collect() == []


def test_hashed_folds_need_no_shuffle(events):
    folds = splits.hashed_folds(events, "rid", 4)
    sizes = Counter(r["fold"] for r in folds.collect())
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) < 1.2 * min(sizes.values())
    assert "Exchange" not in folds._jdf.queryExecution().executedPlan().toString()
