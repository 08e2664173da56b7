"""Nearest-neighbour mutual information against all distances."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.stats import digamma
from eventloom.operators import neighbours
from eventloom.session import materialize

EULER = 0.5772156649015329


def psi(n):
    return -EULER + sum(1 / i for i in range(1, n))


def brute(x, y, k):
    n_of = Counter(y)
    kept = [i for i in range(len(x)) if n_of[y[i]] > 1]
    total = 0.0
    for i in kept:
        own = sorted(abs(x[j] - x[i]) for j in kept if y[j] == y[i] and j != i)
        mine = min(k, len(own))
        d = own[mine - 1]
        near = sum(abs(x[j] - x[i]) < d if d > 0 else x[j] == x[i] for j in kept)
        total += psi(mine) - psi(n_of[y[i]]) - psi(near)
    return max(0.0, psi(len(kept)) + total / len(kept))


def test_digamma(spark):
    values = [1, 2, 3, 7, 100, 10**6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x long").select(digamma(F.col("x"))).collect()]
    assert got[:-1] == pytest.approx([psi(v) for v in values[:-1]], abs=1e-11) and got[-1] == pytest.approx(math.log(10**6) - 5e-7, abs=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 400)
    data = [(int(i), int(c), float(rng.normal(c)), int(rng.integers(0, 6) + c), None if i % 7 == 0 else float(rng.random())) for i, c in enumerate(y)]
    data += [(1000, 77, 0.5, 1, 0.1), (1001, None, 0.4, 2, 0.2), (1002, 88, 0.1, 3, 0.3), (1003, 88, 0.2, 3, None)]
    return spark.createDataFrame(data, "rid long, CAMEOCode int, near double, whole int, noise double").repartition(5).cache()


@pytest.mark.parametrize("hot_rows,block_rows", [(10**6, 10**6), (50, 7), (200, 3)])
def test_scores_equal_all_distances(rows, hot_rows, block_rows):
    got = {r["feature"]: r["mi"] for r in neighbours.neighbour_scores(rows, "rid", noise=0.0, hot_rows=hot_rows, block_rows=block_rows).collect()}
    data = [r for r in rows.collect() if r["CAMEOCode"] is not None]
    for feature in ("near", "whole", "noise"):
        known = [r for r in data if r[feature] is not None]
        expected = brute([float(r[feature]) for r in known], [r["CAMEOCode"] for r in known], 3)
        assert got[feature] == pytest.approx(expected, abs=1e-9)
    assert got["near"] > 0.2 > got["noise"]


def test_noise_tells_equal_values_apart(rows):
    plain = {r["feature"]: r["mi"] for r in neighbours.neighbour_scores(rows, "rid", features=["whole"]).collect()}
    again = {r["feature"]: r["mi"] for r in neighbours.neighbour_scores(rows.repartition(2), "rid", features=["whole"]).collect()}
    assert plain["whole"] == pytest.approx(again["whole"], abs=1e-12) and plain["whole"] > 0.1
    other = neighbours.neighbour_scores(rows, "rid", features=["whole"], seed=1).first()["mi"]
    assert other != plain["whole"] and other == pytest.approx(plain["whole"], abs=0.1)


def test_no_rows_no_score(spark, rows):
    assert neighbours.neighbour_scores(rows.limit(0), "rid").collect() == []
    assert neighbours.neighbour_scores(rows.where("CAMEOCode = 77"), "rid").collect() == []
    same = spark.range(50).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("CAMEOCode"), F.lit(1.0).alias("x"))
    assert neighbours.neighbour_scores(same, "rid", noise=0.0).first()["mi"] == 0.0


def test_steps_are_made_once(spark):
    """What is read several times is stored: the last step does not start from the input again."""
    rows = materialize(spark.range(3000).select(F.col("id").alias("rid"), (F.xxhash64("id") % 4).alias("y"), (F.xxhash64("id", F.lit(1)) % 500).cast("double").alias("x")), "neighbour-input")
    options = {"label": "y", "features": ["x"], "noise": 2.0**-13, "noise_bits": 20}
    found = neighbours.neighbour_scores(rows, "rid", hot_rows=100, block_rows=50, **options)
    assert found.inputFiles() and not any("neighbour-input" in f or "points" in f for f in found.inputFiles())
    at_once = neighbours.neighbour_scores(rows, "rid", **options)
    assert found.first()["mi"] == pytest.approx(at_once.first()["mi"], abs=1e-9)
