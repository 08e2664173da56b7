import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe_codec as B
from eventloom.llm import token_counts as C
from tests.llm.helpers import documents, rows_of, sha

ODD = ["", " ", "a", "  two  spaces \n\n x", "it's <|endoftext|> we'll", "é　ü ß\x1c\x1f z", "1234567 89", "😀 emoji‍", " \t\n ", "a" * 3000, " " * 3000 + "b", "x y " * 2000]
TEXT = st.text(max_size=80)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_parts_encode_as_the_whole(text, most):
    whole = B.codec(B.RANK_FILE).encode_ordinary(text)
    assert B.encode(text, most=most) == whole
    assert B.decode(whole) == text.encode()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_the_whole(text):
    assert B.encode(text, most=7) == B.codec(B.RANK_FILE).encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    assert C.count_tokens(text) == len(C.tokenizer(C.VOCABULARY).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(text, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 2)
    assert C.count_tokens(text) == len(C.tokenizer(C.VOCABULARY).encode(text, add_special_tokens=False).ids)


def test_tables(spark):
    rows = [*enumerate(ODD), (3, None), (None, "no id"), (3, ODD[3])]
    frame = documents(spark, rows, extra=("ids", "n_tokens", "data"))
    got = rows_of(B.digests(frame), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    encode = B.codec(B.RANK_FILE).encode_ordinary
    expected = [(i, len(x := encode(t or "")), sha(np.array(x, "<u4").tobytes()), sha(t or "")) for i, t in rows]
    assert got == sorted(expected, key=str)
    counted = rows_of(C.token_counts(frame, limit=4), "doc_id", "n_bytes", "over_limit")
    assert counted == sorted([(i, len((t or "").encode()), len(C.tokenizer(C.VOCABULARY).encode(t or "").ids) > 4) for i, t in rows], key=str)
    trip = B.decode_ids(B.encode_texts(frame))
    assert all(bytes(r.data).decode() == (r.text or "") for r in trip.collect())
    bad = spark.createDataFrame([([1, 2],), (None,), ([99999999],), ([None],)], "ids array<int>")
    assert [r.data is None for r in B.decode_ids(bad).collect()] == [False, True, True, True]


def test_empty_table(spark):
    assert B.digests(documents(spark, [])).count() == 0
    assert C.token_counts(documents(spark, [])).count() == 0
