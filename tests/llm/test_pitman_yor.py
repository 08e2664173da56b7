import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from eventloom.llm import pitman_yor as P
from tests.llm.helpers import documents, rows_of

RNG = random.Random(4)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    """Counts of the training tokens, and base scores."""
    learnt = [t for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, i is not None and crc32(str(i).encode()) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, base))
    return out


def prose(n):
    """Each word is mostly followed by its one successor."""
    words, at = [], RNG.randrange(60)
    for _ in range(n):
        at = (at * 7 + 1) % 61 if RNG.random() < 0.8 else min(int(RNG.paretovariate(0.5)), 4000)
        words.append(f"w{at}")
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rows = [(i, prose(RNG.randrange(200))) for i in range(250)]
    return [*rows, (None, prose(20)), (3, rows[3][1]), (3, "The THE é"), (900, None), (901, ""), (902, "unseenword " * 4), (903, "w1 " * 5000)]


@pytest.mark.parametrize("contexts,piece", [(1 << 16, 1 << 24), (20, 3000)])
def test_counts_and_base_scores(spark, rows, contexts, piece, monkeypatch):
    monkeypatch.setattr(P, "CONTEXTS", contexts)
    monkeypatch.setattr(P, "PIECE_BYTES", piece)
    found = P.score_documents(documents(spark, rows, extra=("held_out", "g", "piece")).repartition(3)).collect()
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in found) == sorted(map(key, brute(rows)))
    held = [r for r in found if r.held_out]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    if contexts > 20:  # successors are learnt: held-out perplexity is far below that of words alone
        assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.4


def test_probabilities_add_up_and_match_the_groups(spark, rows, monkeypatch):
    """Scores of one-word texts after each context, computed from the whole seating in one place."""
    monkeypatch.setattr(P, "CONTEXTS", 200)
    training = documents(spark, [(1, t) for _, t in rows])
    model, restaurants = P.fit(training.select("text"))
    stored = [(r.g, P.Restaurants.unpacked(bytes(r.b))) for r in restaurants.collect()]
    vocabulary = np.unique(np.concatenate([model.words, *(own.words for _, own in stored)]))
    assert len(vocabulary) == model.known
    for context in (model.start, 0, len(model.words) - 1, model.rare):
        total = 0.0
        for g, own in stored:
            for totals, seating in P._kept(model, own, g):
                parent = totals.root(seating.customers, seating.root_tables, model.known)
                keys = (np.arange(len(own.words)) << P._SHIFT) | context
                at, there = P._found(own.keys, keys)
                of = lambda x: np.where(there, x[at], 0) if len(x) else np.zeros(len(keys))  # noqa: E731, B023
                total += P._predict(model, totals, of(own.counts), of(seating.tables), np.full(len(keys), context), parent).sum() / P.KEPT
        for totals in model.totals[-P.KEPT :]:
            parent = totals.root(totals.frequent_customers, totals.frequent_tables, model.known)
            total += (model.back_off(totals)[context] * parent).sum() / P.KEPT
            total += model.back_off(totals)[context] * totals.root(np.zeros(1), np.zeros(1), model.known)[0] / P.KEPT
        for g, own in stored:
            mine = np.flatnonzero((own.frequent_keys & P._MASK == context) & (context != model.rare))
            for totals, seating in P._kept(model, own, g):
                total += (np.maximum(own.frequent_counts[mine] - P.CONTEXT[0] * seating.frequent_tables[mine], 0) / (P.CONTEXT[1] + model.counts[context] if context != model.rare else 1)).sum() / P.KEPT
        assert total == pytest.approx(1, abs=1e-9), context


def test_seating_has_the_expected_number_of_tables():
    rng = np.random.default_rng(0)
    n, weight, d = 50, 3.0, 0.5
    tables = P.seat(np.full(20_000, n), np.full(20_000, weight), d, rng)
    one_by_one = []
    for _ in range(4000):
        t = 1
        for i in range(1, n):
            t += rng.random() < weight / (weight + i - d * t)
        one_by_one.append(t)
    assert tables.mean() == pytest.approx(np.mean(one_by_one), rel=0.02)
    many = P.seat(np.array([0, 1, 2, 100_000]), np.full(4, 1.0), 0.0, rng)
    assert many[:2].tolist() == [0, 1] and many[3] < 60


def test_shuffle_partitions_do_not_change_scores(spark, rows):
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scores.append({r.doc_id: r.score for r in P.score_documents(documents(spark, rows[:60])).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_partitioning_does_not_change_scores(spark, rows):
    a = rows_of(P.score_documents(documents(spark, rows[:60]).repartition(2)).selectExpr("doc_id", "round(score, 2) as score"), "doc_id", "score")
    b = rows_of(P.score_documents(documents(spark, rows[:60]).repartition(5)).selectExpr("doc_id", "round(score, 2) as score"), "doc_id", "score")
    assert all(x[0] == y[0] and x[1] == pytest.approx(y[1], abs=0.05) for x, y in zip(a, b))


@pytest.mark.parametrize("rows", [[], [(None, "a b")], [(1, None), (8, "")]])
def test_small_tables(spark, rows):
    found = P.score_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows) and all(math.isfinite(r.score) for r in found)


def test_rare_contexts_are_learnt(spark, rows, monkeypatch):
    """With 20 frequent words, held-out text is predicted as well as with all words frequent."""
    gains = []
    for contexts in (1 << 16, 20):
        monkeypatch.setattr(P, "CONTEXTS", contexts)
        held = [r for r in P.score_documents(documents(spark, rows)).collect() if r.held_out]
        gains.append(sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert gains[0] > 0.4 and gains[1] == pytest.approx(gains[0], abs=0.03)


def test_scores_follow_from_the_seating(spark, rows, monkeypatch):
    """Scores computed in one place from all pairs, with sums over each context taken from these."""
    monkeypatch.setattr(P, "CONTEXTS", 200)
    monkeypatch.setattr(P, "PIECE_BYTES", 3000)
    learnt = [(i, t) for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2]
    model, restaurants = P.fit(documents(spark, learnt).select("text"))
    pairs = [{} for _ in range(P.KEPT)]
    at_root = [dict(zip(model.words.tolist(), zip(t.frequent_customers, t.frequent_tables))) for t in model.totals[-P.KEPT :]]
    names = [*model.words.tolist(), "start"]
    for r in restaurants.collect():
        own = P.Restaurants.unpacked(bytes(r.b))
        words, contexts = own.words.tolist(), own.contexts.tolist()
        for k, (_, seating) in enumerate(P._kept(model, own, r.g)):
            for keys, bits, counts, tables, dishes, places in (
                (own.keys, P._SHIFT, own.counts, seating.tables, words, names),
                (own.frequent_keys, P._SHIFT, own.frequent_counts, seating.frequent_tables, names, names),
                (own.rare_keys, P._WIDE, own.rare_counts, seating.rare_tables, words, contexts),
                (own.after_keys, P._WIDE, own.after_counts, seating.after_tables, names, contexts),
            ):
                for key, n, t in zip(keys.tolist(), counts.tolist(), tables.tolist()):
                    pair = (dishes[key >> bits], places[key & ((1 << bits) - 1)])
                    assert pair not in pairs[k]
                    pairs[k][pair] = (n, t)
            at_root[k].update(zip(words, zip(seating.customers.tolist(), seating.root_tables.tolist())))
    everything = Counter()
    hashed = lambda t: P._tokens(P.pa.array([t or ""]))[0].tolist()
    for _, text in learnt:
        own = hashed(text)
        everything.update(zip(own, ["start", *own]))
    assert {pair: n for pair, (n, _) in pairs[0].items()} == everything
    sums = [{} for _ in range(P.KEPT)]
    for k in range(P.KEPT):
        arriving = Counter()
        for (w, c), (n, t) in pairs[k].items():
            customers, tables = sums[k].get(c, (0, 0))
            sums[k][c] = (customers + n, tables + t)
            arriving[w] += t
        assert arriving == Counter({w: n for w, (n, _) in at_root[k].items()})
    d, s = P.CONTEXT

    def score(text):
        total, own = 0.0, hashed(text)
        for w, c in zip(own, ["start", *own]):
            p = 0.0
            for k, totals in enumerate(model.totals[-P.KEPT :]):
                (n, t), (customers, tables) = pairs[k].get((w, c), (0, 0)), sums[k].get(c, (0, 0))
                root = totals.root(*(np.array([x]) for x in at_root[k].get(w, (0, 0))), model.known)[0]
                p += (max(n - d * t, 0) + (s + d * tables) * root) / (s + customers)
            total += math.log10(p / P.KEPT)
        return total

    found = rows_of(P.score_documents(documents(spark, rows).repartition(3)), "doc_id", "n_tokens", "score")
    expected = sorted(((i, len(tokens(t)), score(t)) for i, t in rows), key=str)
    assert sum(c not in names for _, c in pairs[0]) > 400
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert [f[2] for f in found] == pytest.approx([e[2] for e in expected], rel=1e-5)
