import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import minhash as M
from eventloom.llm.components import components
from tests.llm.helpers import documents

RNG = random.Random(11)
VOCAB = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(3000)]


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, threshold):
    """Sets and least reachable ids, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= threshold * (len(sets[x]) + len(sets[y]) - common):
                group[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    ids = [least.get(root(x)) if sets[x] else i for x, (i, _) in enumerate(rows)]
    return sets, ids


def changed(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(VOCAB)
    return words


@pytest.fixture(scope="module")
def rows():
    texts = []
    for _ in range(25):
        base = [RNG.choice(VOCAB) for _ in range(RNG.choice([3, 20, 80, 300]))]
        texts += [" ".join(changed(base, RNG.randrange(1 + len(base) // 15))) for _ in range(RNG.choice([1, 2, 8]))]
        texts += [" ".join(base)] * RNG.choice([0, 3])
    chain = [RNG.choice(VOCAB) for _ in range(200)]
    for i in range(12):  # neighbours are linked, ends are not
        chain[i * 12 : i * 12 + 2] = [RNG.choice(VOCAB), RNG.choice(VOCAB)]
        texts.append(" ".join(chain))
    RNG.shuffle(texts)
    odd = [(None, texts[0]), (5, texts[5]), (5, texts[6]), (900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (905, "x " * 5000), (None, "no copy at all here")]
    return [*enumerate(texts), *odd]


@pytest.mark.parametrize("k,threshold,block", [(3, 85, M.BLOCK), (5, 80, 3)])
def test_groups_equal_brute_force(spark, rows, k, threshold, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    found = M.near_duplicates(documents(spark, rows, extra=("row", "n", "key", "component")), k, threshold)
    sets, ids = brute(rows, k, threshold)
    expected = [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, ids)]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_one_row_of_each_group_stays(spark, rows):
    frame = documents(spark, rows, extra=("doc", "id", "h1"))
    kept = M.deduplicated(frame)
    assert kept.columns == frame.columns
    sets, ids = brute(rows, 5, 80)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {c for (i, _), s, c in zip(rows, sets, ids) if s and c is not None}
    with_words = [i for i, t in got if shingles(t, 5) and i is not None]
    assert sorted(with_words) == sorted(groups)
    assert sum(not shingles(t, 5) for _, t in got) == 3


def test_pairs_within_the_radius_share_a_key(spark):
    most = M.radius(85)
    assert sum(2 for _ in M.chunks(85)) >= most + 1
    base = np.random.default_rng(1).integers(0, 1 << 16, M.SYMBOLS)
    signatures = [base]
    for _ in range(100):
        other = base.copy()
        other[np.random.default_rng(len(signatures)).choice(M.SYMBOLS, most, replace=False)] ^= 1
        signatures.append(other)
    frame = spark.createDataFrame([(i, bytearray(s.astype("<u2").tobytes())) for i, s in enumerate(signatures)], "node long, signature binary")
    keys = {}
    for r in M.with_keys(frame, 85).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert all(keys[0] & keys[i] for i in keys)


def test_signatures_estimate_similarity():
    a, b = [" ".join(VOCAB[low:high]) for low, high in ((0, 1000), (100, 1100))]
    x, y = (np.frombuffer(s, "<u2") for s in M._signatures(M.shingle_sets(pa.array([a, b]), 1)))
    assert abs((x == y).mean() - 900 / 1100) < 0.15


def test_empty_and_single(spark):
    assert M.near_duplicates(documents(spark, [])).count() == 0
    assert [r.kept for r in M.near_duplicates(documents(spark, [(1, None)])).collect()] == [True]
    assert M.deduplicated(documents(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 6), (139, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(100, 140), 300], 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
