import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import spelling as S
from tests.llm.helpers import documents, rows_of

LOWER = str.maketrans(S.UPPER, S.LOWER)
COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(docs, drop_every=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    best, out = {}, []
    for w in words:
        others = [x for x in words if near(w, x)]
        top = min(others, key=lambda x: (-words[x], x), default=None)
        best[w] = (len(others), top if top is not None and words[top] >= 10 * words[w] else None)
    for w, n in words.items():
        root = w
        while best[root][1] is not None:
            root = best[root][1]
        form = best[w][1]
        out.append((w, n, best[w][0], form, words[form] if form else None, root))
    return sorted(out, key=str)


def check(spark, docs, **options):
    got = rows_of(S.group_spellings(documents(spark, docs, extra=("word", "n", "run", "h")), **options), *COLUMNS)
    assert got == brute(docs, options.get("drop_every", 31))


DOCS = [
    (1, "receive " * 200 + "recieve receeve Receve " * 2), (2, "receiver receiver RECEIVÉ receivé receivÉ"), (3, None), (4, ""), (None, "colours colours colour colours"),
    (None, "colours colours colour colours"), (5, "colors! colors, color's"), (6, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ ÀÉÎÕÜßÿx ÀÉÎÕÜßÿx"), (7, "a" * 30_000 + " " + "a" * 30_000 + " " + "a" * 29_999 + "b " + "a" * 29_999 + "b"),
    (8, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaab aaaaaaab baaaaaaa baaaaaaa"), (9, "ſeventy seventy7seventy Straßen straßen strasen"),
]


def test_groups_equal_brute_force(spark):
    check(spark, DOCS)
    check(spark, DOCS, drop_every=2)


def test_forms_follow_one_another(spark):
    docs = [(1, "chained " * 1000 + "chainee " * 100 + "chainfe " * 10 + "cheinfe " * 2 + "dheinfe " * 2)]
    roots = {r.word: r for r in S.group_spellings(documents(spark, docs), drop_every=1 << 40).collect()}
    assert roots["chainfe"].root == "chained" and roots["chainfe"].form == "chainee" and roots["cheinfe"].form is None and roots["cheinfe"].n_near == 2
    check(spark, docs, drop_every=1 << 40)


def test_an_equal_count_takes_the_first_word(spark):
    docs = [(1, "abcdefg " * 30 + "abcdefi " * 30 + "abcdefh " * 2)]
    row = {r.word: r for r in S.group_spellings(documents(spark, docs), drop_every=1 << 40).collect()}["abcdefh"]
    assert row.form == "abcdefg" and row.n_near == 2 and row.form_n == 30


def test_every_single_change_shares_a_signature(spark):
    """All inserted, deleted and replaced letters of some words, for more partitions than the default."""
    letters = "abcéz"
    words = {"letters", "aaaaaaa", "éclairsé"}
    for w in list(words):
        words |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    expected = {(a, b) for a in words for b in words if near(a, b)}
    for first, second in ((1, 5), (1, 4), (2, 3), (3, 1)):
        found = {(r.word, r.other) for r in S.near_words(table, first, second).collect()}
        assert found == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abé", min_size=6, max_size=9), min_size=1, max_size=60))
def test_random_words(spark, words):
    check(spark, [(i, " ".join([w, w])) for i, w in enumerate(words)])


def test_empty_table(spark):
    assert S.group_spellings(documents(spark, [])).collect() == []
    assert S.group_spellings(documents(spark, [(1, "few"), (2, None)])).select(F.count("*")).first()[0] == 0
