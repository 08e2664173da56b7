import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import substring_dedup as S
from eventloom.llm.text import Words, not_spaces
from tests.llm.helpers import documents, rows_of, sha

RNG = random.Random(2)


def brute(rows, width):
    """Windows by their words; the smallest id of each."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), words in zip(rows, split):
        for k in range(len(words) - width + 1) if i is not None else ():
            w = tuple(words[k : k + width])
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, _), words in zip(rows, split):
        gone = set()
        for k in range(len(words) - width + 1) if i is not None else ():
            if least[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.fixture(scope="module")
def rows():
    passage = [" ".join(RNG.choices("abcdefgh", k=RNG.choice([5, 13, 14, 40]))) for _ in range(12)]
    rows = []
    for i in range(120):
        text = [" ".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randrange(30))) for _ in range(3)]
        text[1:1] = RNG.sample(passage, RNG.randrange(3))
        rows.append((RNG.randrange(-50, 1000), "\n".join(text)))
    rows += [(None, passage[3] * 2), (5, None), (6, ""), (7, " \t "), (rows[0][0], rows[0][1]), (rows[0][0], passage[3]), (2000, "x " * 20_000), (2001, "x " * 30), (2002, "é\x0b" * 14)]
    rows += [(3000 + i, passage[11] + f" tail{i}") for i in range(60)]
    return rows


@pytest.mark.parametrize("width,group,piece", [(13, S.GROUP, S.PIECE_BYTES), (13, 50, 300), (4, 200, 5000)])
def test_equals_brute_force(spark, rows, width, group, piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", piece)
    frame = documents(spark, rows, extra=("h", "starts", "may", "g")).repartition(5)
    got = rows_of(S.without_repeats(frame, width, group), "doc_id", "n_words", "n_removed", "text")
    assert got == sorted(brute(rows, width), key=str)
    digests = rows_of(S.without_repeats(frame, width, group, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert digests == sorted(((i, n, m, sha(t)) for i, n, m, t in brute(rows, width)), key=str)


def test_empty_tables(spark):
    assert S.without_repeats(documents(spark, [])).count() == 0
    assert S.without_repeats(documents(spark, [(None, None)])).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30).map(sorted), st.data())
def test_packed_suffixes_come_back(row, data):
    row = np.array(row, np.int64)
    ids = np.array([data.draw(st.integers(-(2**62), 2**62)) for _ in range(6)], np.int64)
    hashes = np.arange(6, dtype=np.int32) - 3
    place = np.concatenate([[], *(np.arange((row == r).sum()) * 3 + 1 for r in np.unique(row))]).astype(np.int64)
    keys = np.arange(len(row), dtype=np.uint64) * np.uint64(2**50 + 1)
    for k in (keys, keys[:0]):
        a, h, p, got = S._unpack(S._pack(ids, hashes, row, place, k))
        assert (a == ids[row]).all() and (h == hashes[row]).all() and (p == place).all() and (got == k).all()


def test_common_words_get_longer_prefixes():
    words = Words(pa.array(["the " * 2000 + " ".join(f"w{i}" for i in range(2000)) + " the" * 13]), not_spaces())
    counts = np.bincount((words.hashes >> np.uint64(52)).astype(int), minlength=S.CLASSES)
    at = words.windows(13)
    groups = S.prefix_groups(words, at, counts / counts.sum(), 1 / 64, 16, 13)
    rare = np.bincount(groups[(at >= 2000) & (at < 3900)], minlength=16)
    assert rare.max() < 3 * rare.mean()
    # A word that is half of all words does not alone choose the group.
    mixed = Words(pa.array([" ".join(f"the w{i}" for i in range(3000))]), not_spaces())
    counts = np.bincount((mixed.hashes >> np.uint64(52)).astype(int), minlength=S.CLASSES)
    at = mixed.windows(13)[::2]
    groups = np.bincount(S.prefix_groups(mixed, at, counts / counts.sum(), 1 / 64, 16, 13), minlength=16)
    assert groups.max() < 3 * groups.mean()


def test_a_full_group_takes_little_memory():
    """Executors hold as many groups as they have cores, beside the JVM."""
    import tracemalloc

    rng = np.random.default_rng(0)
    row = np.sort(rng.integers(0, 5000, S.GROUP))
    blob = S._pack(np.arange(5000) * 7, np.arange(5000, dtype=np.int32), row, np.arange(S.GROUP), rng.integers(0, 1 << 63, S.GROUP).astype(np.uint64))
    tracemalloc.start()
    ids, _, _, keys = S._unpack(blob)
    S._repeats_of(ids, keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20, peak >> 20
