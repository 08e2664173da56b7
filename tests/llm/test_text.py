import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import text as X

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \n\té~\x0b\x1c", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    for table, lower, pattern in ((X.not_spaces(), False, rb"[^\x20\x09-\x0D]+"), (X.letters_and_digits(), True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = X.Words(pa.array(texts, pa.string()), table, lower)
        for i, text in enumerate(texts):
            data = (text or "").encode()
            expected = re.findall(pattern, data.lower() if lower else data)
            assert [words.word(k) for k in range(words.first[i], words.first[i + 1])] == expected


def test_hashes_depend_on_the_word_alone(monkeypatch):
    texts = ["one two three one", "x" * 300 + " one", None, "", "two"]
    words = X.Words(pa.array(texts), X.not_spaces())
    by_word = {}
    for i, h in enumerate(words.hashes):
        assert by_word.setdefault(words.word(i), h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(X, "HASH_BYTES", 16)
    again = X.Words(pa.array(texts), X.not_spaces())
    assert (again.hashes == words.hashes).all()


def test_windows_stay_in_their_text():
    words = X.Words(pa.array(["a b c", "d", None, "e f g h"]), X.not_spaces())
    assert words.windows(3).tolist() == [0, 4, 5]
    assert len(X.rolling(words.hashes, range(3))) == 6
    assert X.Words(pa.array([], pa.string()), X.not_spaces()).windows(3).tolist() == []


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_pieces_keep_all_rows(most):
    batch = pa.record_batch({"text": pa.array(["abc", None, "", "defghijkl", "m"])})
    got = [r for p in X.pieces(iter([batch]), most) for r in p.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()
    assert np.all([p.num_rows >= 1 for p in X.pieces(iter([batch]), most)])
