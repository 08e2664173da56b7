"""Histogram, correlation, mutual information, scores."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import evaluation, profiling


def test_histogram_shows_empty_classes_and_ignores_others(spark):
    df = spark.createDataFrame([(x,) for x in [0, 0, 5, 22, 23, 54, None]], "CAMEOCode int")
    found = {r["label"]: r["n"] for r in profiling.class_histogram(df).collect()}
    assert found == {**dict.fromkeys(range(23), 0), 0: 2, 5: 1, 22: 1}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        a = rng.gauss(1e6, 3)
        b = None if rng.random() < 0.2 else a * 2 + rng.gauss(0, 5)
        c = None if rng.random() < 0.3 else rng.randint(0, 9)
        rows.append((a, b, c, 7, None if i % 2 else -3.25, rng.randint(0, 3)))
    return rows


SCHEMA = "a double, b double, c int, constant int, halfconstant double, label int"


def test_correlation_is_pairwise_complete(spark, table):
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    found = {(r["a"], r["b"]): r["r"] for r in profiling.correlation_matrix(df).collect()}
    expected = pd.DataFrame(table, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype(float).corr()
    assert len(found) == 36
    for (a, b), r in found.items():
        want = expected.loc[a, b]
        if "constant" in a + b:
            assert r is None
        else:
            assert r == pytest.approx(want, abs=1e-9)


def test_correlation_of_a_subset_that_is_constant(spark):
    rows = [(1.0, None), (2.0, 5.0), (2.0, 6.0), (9.0, None)]
    found = profiling.correlation_matrix(spark.createDataFrame(rows, "x double, y double"))
    assert {(r["a"], r["b"]): r["r"] is None for r in found.collect()} == {
        ("x", "x"): False, ("y", "y"): False, ("x", "y"): True, ("y", "x"): True
    }


def test_correlation_of_far_columns_that_start_late(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") >= 2000, F.col("id") * 1e-3 + 1e9).alias("far"),
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(-F.col("id").cast("double")).alias("holes"),
    )
    found = {(r["a"], r["b"]): r["r"] for r in profiling.correlation_matrix(df, ["id", "far", "holes"]).collect()}
    assert found["id", "far"] == pytest.approx(1, abs=1e-6) and found["holes", "far"] == pytest.approx(-1, abs=1e-6)
    assert len(found) == 9 and found["far", "far"] == pytest.approx(1)


def test_correlation_of_many_columns(spark):
    df = spark.range(50).select(*[((F.col("id") * (i + 3)) % 61).alias(f"c{i}") for i in range(64)])
    found = {(r["a"], r["b"]): r["r"] for r in profiling.correlation_matrix(df).collect()}
    expected = df.toPandas().corr()
    assert len(found) == 4096
    for i in range(0, 64, 9):
        for j in range(64):
            want, got = expected.loc[f"c{i}", f"c{j}"], found[f"c{i}", f"c{j}"]
            # c58 is constant: no correlation, which the other side writes as NaN.
            assert got is None if math.isnan(want) else got == pytest.approx(want)


def mutual_information(pairs):
    pairs = [p for p in pairs if None not in p]
    n, joint = len(pairs), Counter(pairs)
    left, right = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    return sum(c / n * math.log(c * n / (left[x] * right[y])) for (x, y), c in joint.items())


def test_feature_scores(spark, table):
    rows = [(int(r[0]) % 5, r[2], r[5], (r[5] + 1) * 2) for r in table]
    df = spark.createDataFrame(rows, "p int, q int, label int, copy int")
    found = {r["feature"]: r["mi"] for r in profiling.feature_scores(df, "label").collect()}
    for at, name in ((0, "p"), (1, "q"), (3, "copy")):
        assert found[name] == pytest.approx(mutual_information([(r[at], r[2]) for r in rows]), abs=1e-9)
    best = [r["feature"] for r in profiling.top_k_features(profiling.feature_scores(df, "label"), 1).collect()]
    assert best == ["copy"]
    assert profiling.top_k_features(profiling.feature_scores(df, "label")).count() == 3


def test_text_and_number_features_together(spark):
    rows = [("x", 1.0, 0), ("x", 1.0, 0), ("y", 2.0, 1), ("y", 1.0, 1)]
    found = profiling.feature_scores(spark.createDataFrame(rows, "t string, d double, label int"), "label")
    mi = {r["feature"]: r["mi"] for r in found.collect()}
    assert mi["t"] == pytest.approx(math.log(2)) and 0 < mi["d"] < mi["t"]


def test_bins_hold_the_ends(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-90, 90, 19)], "x double")
    bins = [r["x"] for r in profiling.equal_width_bins(df, ["x"], 10).collect()]
    assert sorted(set(bins)) == list(range(10)) and bins[0] == 0 and bins[-1] == 9


def test_accuracy_of_ten_hand_written_rows(spark):
    rows = [(i, float(i), float(i) + (i >= 7)) for i in range(10)]
    df = spark.createDataFrame(rows, "key int, label double, prediction double")
    score = evaluation.accuracy(df).first()
    assert score["n"] == 10 and score["accuracy"] == pytest.approx(0.7)
    assert score["test_error"] == pytest.approx(0.3)
    folds = evaluation.accuracy(df.withColumn("fold", F.col("key") % 2), by=["fold"])
    mean = evaluation.mean_score(folds).first()
    assert mean["mean_score"] == pytest.approx(0.7) and mean["std_score"] == pytest.approx(0.1)


def test_distinct_labels(spark):
    df = spark.createDataFrame([(3,), (1,), (3,)], "CAMEOCode int")
    assert sorted(r["label"] for r in profiling.distinct_labels(df).collect()) == [1, 3]


def test_correlation_of_many_columns_with_holes(spark):
    """Each column misses other rows, one has no row with another, one is constant where it is present."""
    value = lambda i: ((F.col("id") * (i + 3) + i * i) % 101).cast("double")
    columns = [F.when(F.col("id") % (i + 2) != 1, value(i)).alias(f"c{i}") for i in range(17)]
    columns += [F.when(F.col("id") % 2 == 0, F.col("id") + 1e9).alias("even"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("odd"), F.when(F.col("id") < 5, 7.5).alias("same"), F.lit(None).cast("double").alias("none")]
    df = spark.range(700).select(*columns).repartition(6)
    found = {(r["a"], r["b"]): r["r"] for r in profiling.correlation_matrix(df).collect()}
    expected = df.toPandas().astype(float).corr()
    assert len(found) == 21 * 21
    for (a, b), got in found.items():
        want = expected.loc[a, b]
        if "same" in (a, b) or "none" in (a, b) or math.isnan(want):
            assert got is None
        else:
            assert got == pytest.approx(want, abs=1e-7)


def test_many_columns_take_one_pass_beside_the_means(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 3) % 61).alias(f"c{i}") for i in range(64)])
    plan = profiling.correlation_matrix(df).where("a < b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
