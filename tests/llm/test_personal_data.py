import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import personal_data as P
from eventloom.llm.text import read_table
from tests.llm.helpers import documents, rows_of, sha

DIGITS = lambda m: re.sub("[^0-9]", "", m[0])
PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(DIGITS(m)) <= 19 and P.luhn(DIGITS(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(DIGITS(m)) <= 15),
}
ODD = [
    None, "", "plain words", "mail a.b@mail4.example.com now", "a@b.c@d.e @x.y %@q.r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4",
    "card 4539 1488 0343 6467, 4539-1488-0343-6467 and 4539148803436467", "two 4539148803436467 4539148803436467 cards",
    "+1 (826) 555-4081 190.137.223.104", "+1 (826) 555-4081 x", "é+49 30 1234567890 ünd ٣٣٣ 1٣", "@" * 50, "1." * 500, "9" * 5000,
    "+1" * 30, "name [at] host [dot] org", "4539148803436467 " * 40,
]


def base(text):
    spans = [(m.start(), n, kind, m.end()) for n, (kind, (pattern, keep)) in enumerate(PATTERNS.items()) for m in re.finditer(pattern, text) if keep(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


@pytest.fixture(scope="module")
def chain():
    return P._fit(P.labelled_sentences(), 100, 0.15, 1e-4)


def test_digests_equal_brute_force(spark, chain):
    rows = [*enumerate(ODD), (None, ODD[3]), (3, ODD[3])]
    got = rows_of(P.digests(documents(spark, rows, extra=("spans", "base", "found")), chain), "doc_id", *(f"n_{k}" for k in P.BASE_KINDS), "base_sha256")
    expected = []
    for i, text in rows:
        spans = base(text or "")
        expected.append((i, *(sum(s.startswith(k) for s in spans) for k in P.BASE_KINDS), sha(",".join(spans))))
    assert got == sorted(expected, key=str)


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-+ 0123456789()é", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    found = sorted(P.base_spans(text), key=lambda s: (s[1], P.BASE_KINDS.index(s[0])))
    assert [f"{k}:{s}:{e}" for k, s, e in found] == base(text)


def test_patterns_take_linear_time(chain):
    for text in ("9" * 400_000, "a" * 400_000, "1." * 200_000, "+" * 400_000, "+1 " * 130_000, "@" * 400_000, "a.a@" * 100_000, "1 2-" * 100_000):
        P.base_spans(text)
    P.find_spans(["7 " * 30_000], chain)


def test_likely_spans_come_beside_certain_ones(chain):
    text = "Des +1 (826) 555-4081 190.137.223.104 then 4539148803436467 4539148803436467 end"
    ((certain, likely),) = P.find_spans([text], chain)
    assert [text[s:e] for _, s, e in certain] == ["190.137.223.104"]
    assert {(k, text[s:e]) for k, s, e in likely} == {("likely_phone", "+1 (826) 555-4081"), ("likely_card", "4539148803436467")}
    ((certain, likely),) = P.find_spans(["words 2021-03-04 and 12:30:55, 1,234.56 of 40 %"], chain)
    assert not certain and not likely


def test_held_out_sentences_are_labelled(chain):
    hits = wanted = found = 0
    for text, spans in P.labelled_sentences(300, seed=99):
        certain, likely = P.find_spans([text], chain)[0]
        got = {(k.removeprefix("likely_"), s, e) for k, s, e in [*certain, *likely]}
        hits, wanted, found = hits + len(got & set(spans)), wanted + len(spans), found + len(got)
    assert hits >= 0.9 * wanted and hits >= 0.9 * found


def test_viterbi_equals_all_paths(chain):
    rng = np.random.default_rng(3)
    lengths, tags = np.array([3, 1, 4]), chain.weights.shape[1]
    scores = rng.normal(size=(8, tags))
    got = chain.decode(scores, lengths)
    at = 0
    for n in lengths:
        paths = np.stack(np.meshgrid(*[np.arange(tags)] * n, indexing="ij"), -1).reshape(-1, n)
        total = chain.first[paths[:, 0]] + sum(scores[at + i, paths[:, i]] for i in range(n)) + sum(chain.moves[paths[:, i], paths[:, i + 1]] for i in range(n - 1))
        assert list(got[at : at + n]) == list(paths[total.argmax()])
        at += n


def test_gradient_fits_the_labelled_table(spark, chain):
    table = P.labelled_table(spark, 60)
    again = P.fit_chain(table, steps=40)
    sentences = [(r.text, r.spans) for r in table.collect()]
    right = total = 0
    for text, spans in sentences:
        if tokens := P._tokens(text, 0, len(text), {}):
            gold = P._tags(tokens, [tuple(s) for s in spans])
            got = again.decode(again.emissions(P._contexts(tokens)), np.array([len(tokens)]))
            right, total = right + int((got == gold).sum()), total + len(gold)
    assert right >= 0.99 * total


def test_empty_table(spark, chain):
    assert P.digests(documents(spark, []), chain).collect() == []


def test_given_documents(spark, sf, chain):
    docs = read_table(spark, sf, "documents")
    found = P.find_personal_data(docs, chain).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(texts)
    for r in found:
        assert sorted(f"{s.kind}:{s.start}:{s.end}" for s in r.base) == sorted(base(texts[r.doc_id] or ""))
