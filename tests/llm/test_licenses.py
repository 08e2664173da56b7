import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventloom.llm import licenses as L
from tests.llm.helpers import documents, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Licensed under CC BY-NC 4.0."
ODD = [
    None, "", "Released under the MIT License.", NOTICE, "cc by", "cc  --by cc by", "apache é license apache license", "GNU General Public License " * 500,
    "this work is licensed today under the gnu general public license version 3", "nothing to see", "mit\x00license MIT LICENSE", "general public license",
    "Permission is hereby granted, free of charge, to any one obtaining a copy of this software and associated documentation files",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def brute(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(spark, texts):
    rows = [*enumerate(texts), (None, NOTICE), (3, NOTICE)]
    got = rows_of(L.find_licenses(documents(spark, rows, extra=("row", "hits", "hash", "n_words"))), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_base_equals_brute_force(spark):
    check(spark, ODD)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["cc", "by", "mit", "license", "apache", "gnu", "general", "public", "x"]), max_size=30).map(" ".join), min_size=20, max_size=20))
def test_random_words_equal_brute_force(spark, texts):
    check(spark, texts)


def test_labels_of_notices(spark):
    found = {r.doc_id: r for r in L.find_licenses(documents(spark, list(enumerate(ODD)))).collect()}
    assert found[3].labels == "cc-by,cc-by-nc-4.0" and found[3].score == 1.0
    assert found[8].labels == "gpl,gpl-3.0"  # a word put in shifts the diagonal
    assert found[12].labels == "mit" and found[12].base_labels == "" and 0.75 <= found[12].score < 1
    assert found[9].labels == "" and found[9].score == 0.0
    assert found[11].labels == ""


def test_empty_table(spark):
    assert L.find_licenses(documents(spark, [])).count() == 0
