import itertools
import random
import re

import numpy as np
import pytest

from eventloom.llm import decontamination as D
from tests.llm.helpers import documents

RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghijk", k=4)) for _ in range(400)]


def prose(n, rng=RNG):
    return [rng.choice(VOCAB) for _ in range(n)]


def items(spark, rows, extra=False):
    return spark.createDataFrame([(i, t, "x")[: 3 if extra else 2] for i, t in rows], "item_id long, text string" + (", words string" if extra else ""))


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def brute(text, item):
    """All diagonals and all stretches."""
    a, b = words_of(text), words_of(item)
    if len(b) < D.SHORTEST:
        return False
    for d in range(-len(b), len(a)):
        equal = [a[p] == b[p - d] for p in range(max(d, 0), min(len(a), len(b) + d))]
        sums = np.concatenate([[0], np.cumsum(equal)])
        for s in range(len(equal)):
            for e in range(s + min(D.MIN_WORDS, len(b)), len(equal) + 1):
                begins = equal[s] or (s == 0 and d >= 0)  # the item's own first word
                ends = equal[e - 1] or (e == len(equal) and len(a) >= len(b) + d)
                if begins and ends and any(equal[s:e]) and sums[e] - sums[s] >= D.SIMILARITY * (e - s) - 1e-9:
                    return True
    return False


@pytest.fixture(scope="module")
def tables():
    bench = [prose(n) for n in (30, 15, 9, 40, 5, 20)]
    docs = []
    for i in range(40):
        text = prose(RNG.randint(0, 60))
        if i % 2:
            passage = list(RNG.choice(bench))
            if i % 4 == 1 and len(passage) > 12:  # every eighth word another
                passage = [w if k % 8 != 3 else "zzz" for k, w in enumerate(passage)]
            at = RNG.randint(0, len(text))
            text[at:at] = passage[: RNG.randint(len(passage) // 2, len(passage))]
        docs.append((i, " ".join(text).capitalize().replace(" ", ".\n", 3)))
    docs += [(3, docs[3][1]), (None, " ".join(bench[0])), (99, None), (98, ""), (97, " ".join(bench[2])), (96, " ".join(bench[4]))]
    return docs, [*((i, " ".join(b)) for i, b in enumerate(bench)), (7, None), (8, ""), (0, " ".join(bench[0])), (None, " ".join(bench[5]))]


def test_equals_brute_force(spark, tables, monkeypatch):
    docs, bench = tables
    expected = sorted(((d, i) for d, t in docs for i, b in bench if brute(t, b)), key=str)
    assert len(expected) > 15
    for limit in (D.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(D, "BROADCAST_SEEDS", limit)
        found = D.find_leaks(documents(spark, docs, extra=("row", "seeds", "item")), items(spark, bench, extra=True)).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == expected
        assert all(r.similarity >= D.SIMILARITY - 1e-9 and r.n_equal <= r.n_words for r in found)


def test_leaking_rows_go_and_others_stay(spark, tables):
    docs, bench = tables
    frame = documents(spark, docs, extra=("key", "leak"))
    kept = D.decontaminate(frame, items(spark, bench))
    assert kept.columns == frame.columns
    expected = [(d, t) for d, t in docs if not any(brute(t, b) for _, b in bench)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_empty_tables(spark, tables):
    docs, bench = tables
    assert D.find_leaks(documents(spark, []), items(spark, bench)).count() == 0
    assert D.find_leaks(documents(spark, docs), items(spark, [])).count() == 0
    assert D.decontaminate(documents(spark, docs), items(spark, [])).count() == len(docs)


def most_equal(n, ends):
    """The most equal words among n (the outer two equal, if ``ends``) of which no mask finds its six."""
    masks = [(int(m, 2), len(m)) for m in D.MASKS]
    width = max(length for _, length in masks)
    best = {1: 1} if ends else {0: 0, 1: 1}  # by the last words, as bits
    for i in range(1, n):
        after = {}
        for state, count in best.items():
            for bit in (1,) if ends and i == n - 1 else (0, 1):
                row = state << 1 | bit
                if not any(row & m == m for m, _ in masks):
                    row &= (1 << (width - 1)) - 1
                    after[row] = max(after.get(row, 0), count + bit)
        best = after
    return max(best.values())


def test_masks_hit_every_accepted_stretch():
    assert all(10 * most_equal(n, True) < 8 * n for n in range(D.SHORTEST, 40))
    # A stretch may begin or end with changed words where the item does; and a longer row is cut
    # into rows of 20 to 39 words, each of which has too few equal words.
    assert all(10 * most_equal(n, False) < 8 * n for n in range(D.SHORTEST, 40))


def changed(words, at):
    return " ".join(f"zz{k}" if k in at else w for k, w in enumerate(words))


def test_every_placement_of_substitutions(spark):
    bench = [prose(n) for n in (8, 9, 10, 11, 12, 13, 15, 20, 40, 500)]
    docs = []
    for i, b in enumerate(bench):
        if len(b) <= 15:
            docs += [(i, changed(b, at)) for at in itertools.combinations(range(len(b)), len(b) // 5)]
        docs += [(i, changed(b, range(phase, len(b), 5))) for phase in range(5)]
    # A dozen equal words among others, and a stretch that counts on the same diagonal.
    docs.append((8, changed(bench[8], [0, 1, 2, *range(15, 23), 36, 37, 38, 39])))
    docs = [(k, f"{' '.join(prose(k % 3))} {t}", i) for k, (i, t) in enumerate(docs)]
    expected = [k for k, t, i in docs if len(bench[i]) > 40 or brute(t, " ".join(bench[i]))]
    assert len(expected) > 500
    found = D.find_leaks(documents(spark, [d[:2] for d in docs]), items(spark, [(i, " ".join(b)) for i, b in enumerate(bench)])).collect()
    own = {k: i for k, _, i in docs}
    assert sorted(r.doc_id for r in found if own[r.doc_id] == r.item_id) == expected


def test_a_change_at_either_end_of_an_item_is_found(spark):
    """Every single changed word of short items, first and last included, inside and at the ends of a text."""
    bench = [prose(n) for n in range(8, 14)]
    docs = [(i, p, around) for i, b in enumerate(bench) for p in range(len(b)) for around in (False, True)]
    texts = [" ".join([*(["before"] * around), changed(bench[i], [p]), *(["after"] * around)]) for i, p, around in docs]
    found = D.find_leaks(documents(spark, list(enumerate(texts))), items(spark, [(i, " ".join(b)) for i, b in enumerate(bench)])).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(k, i) for k, (i, _, _) in enumerate(docs)}
    assert all(r.n_equal >= r.n_words - 1 for r in found if docs[r.doc_id][0] == r.item_id)


def test_longest_stretch_has_equal_ends():
    equal = [c == "1" for c in "1" * 12 + "0" * 10 + "1101111011111"]
    assert D._longest_similar(np.array(equal), D.SIMILARITY) == (22, 35)
    assert D._longest_similar(np.zeros(5, bool), D.SIMILARITY) == (0, 0)
