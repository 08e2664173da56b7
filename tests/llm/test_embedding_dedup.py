import math

import numpy as np
import pytest

from eventloom.llm import embedding_dedup as E
from tests.llm.helpers import rows_of


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, node string, key string, vector string")


def brute(rows):
    def usable(v):
        return v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    n = len(rows)
    links, reach = [0] * n, list(range(n))

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for x in range(n):
        for y in range(x):
            (a, la), (b, lb) = rows[x][1:3], rows[y][1:3]
            if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            a, b = np.array(a, float), np.array(b, float)
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[x] += 1
                links[y] += 1
                reach[root(x)] = root(y)
    least = {}
    for x in range(n):
        if rows[x][0] is not None:
            least[root(x)] = min(least.get(root(x), rows[x][0]), rows[x][0])
    ids = [least.get(root(x)) for x in range(n)]
    return [(r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, ids)]


def clusters(rng, n, d):
    rows = []
    centre = rng.normal(size=(12, d))
    for i in range(n):
        v = centre[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, np.float32(v * rng.choice([1, 3])).tolist(), int(rng.integers(3)), "", "", ""))
    return rows


@pytest.mark.parametrize("block,leaf", [(2048, 128), (7, 2)])
def test_equals_brute_force(spark, block, leaf, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = clusters(rng, 150, 10)
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2], "", "", "") for i in range(20)]  # copies
    line = [(2000 + i, [math.cos(i / 8), math.sin(i / 8)], 1, "", "", "") for i in range(9)]  # chained links
    odd = [
        (3000, None, 1), (3001, [], 1), (3002, [0.0, -0.0], 1), (3003, [float("nan"), 1.0], 1), (3004, [None, 1.0], 1), (3005, [float("inf"), 1.0], 1),
        (3006, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (3007, [2.0, -0.0], 2), (3007, [3.0, 0.0], 2), (3008, [1e-30, 0.0], 2), (3009, [1.0], 2),
    ]
    rows += line + [(*r, "", "", "") for r in odd]
    got = rows_of(E.near_vectors(table(spark, rows, "double")), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute(rows), key=str)


def test_distant_intervals_are_skipped(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = np.sort(rng.normal(size=(400, 2)), axis=0)
    block = {"size": 400, "nodes": np.arange(400).tobytes(), "copies": np.ones(400, np.int64).tobytes(), "vectors": vectors.tobytes()}
    seen = []
    whole = E._Interval.apart
    monkeypatch.setattr(E, "LEAF", 8)
    monkeypatch.setattr(E._Interval, "apart", lambda a, b, e: seen.append(x := whole(a, b, e)) or x)
    E._links(block, None, 0.999, np.eye(2))
    assert sum(seen) > 50


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "", "", "")], [(1, [1.0, 2.0], 1, "", "", "")]])
def test_small_tables(spark, rows):
    got = rows_of(E.near_vectors(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == [(r[0], 0, r[0], True) for r in rows]


@pytest.mark.parametrize("kind,labels", [("string", ["a", "b", None]), ("long", [3_000_000_000, 3_000_000_001, None])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 0.001 * i], labels[i % 3]) for i in range(9)]
    found = E.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}"), threshold=0.98).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (2, i % 3) if i % 3 < 2 else (0, i) for i in range(9)}
