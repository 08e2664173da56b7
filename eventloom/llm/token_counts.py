"""Token counts without encoding: most pre-tokens are one token, as an offline proof shows.

The proof: every string of the vocabulary that the library encodes, alone, as one token is kept.
A text is split at special tokens as the library does, its parts into pre-tokens by the pattern
of the vocabulary; a pre-token of the proven set counts 1, and only the others are merged, each
distinct one once per worker (the memory of merged ones is emptied when it is full).

Nulls in ``text`` count as empty: 0 bytes, 0 tokens. Null and repeated ids are carried along.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.bpe_codec import resolve, safe_parts
from eventloom.llm.text import small_batches

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 500_000
#: Pre-tokens longer than this are merged, but not remembered.
REMEMBERED_CHARS = 64


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(resolve(vocabulary))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def proven(vocabulary: str) -> frozenset[str]:
    """Pre-tokens that are one token each: tried, not assumed from their being in the vocabulary."""
    import public_tokenizers

    loaded, split = tokenizer(vocabulary), regex.compile(public_tokenizers.PATTERN)
    ids = list(range(loaded.get_vocab_size(with_added_tokens=False)))
    texts = loaded.decode_batch([[i] for i in ids], skip_special_tokens=False)
    tried = [t for t in texts if t and "�" not in t and split.fullmatch(t) and split.findall(t) == [t]]
    return frozenset(t for t, e in zip(tried, loaded.encode_batch(tried, add_special_tokens=False)) if len(e.ids) == 1)


class Counts(dict):
    """Tokens of a pre-token."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.vocabulary, self.merged = vocabulary, 0
        self._refill()

    def _refill(self) -> None:
        self.clear()
        self.update(dict.fromkeys(proven(self.vocabulary), 1))
        self.merged = 0

    def __missing__(self, pre_token: str) -> int:
        n = len(tokenizer(self.vocabulary).encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= REMEMBERED_CHARS:
            if self.merged >= REMEMBERED:
                self._refill()
            self.merged += 1
            self[pre_token] = n
        return n


@lru_cache(maxsize=2)
def _counter(vocabulary: str):
    import public_tokenizers

    specials = [t.content for t in tokenizer(vocabulary).get_added_tokens_decoder().values() if t.special]
    split = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    return Counts(vocabulary), regex.compile(public_tokenizers.PATTERN), split, specials


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    counts, pattern, special, specials = _counter(vocabulary)
    total, parts = 0, [text]
    if any(s in text for s in specials):
        parts = special.split(text)
        total = len(parts) - 1
    for part in parts:
        for piece in safe_parts(part):
            total += sum(map(counts.__getitem__, pattern.findall(piece)))
    return total


def token_counts(documents: DataFrame, limit: int = 512, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens are more than ``limit``."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([count_tokens(t.as_py() or "", vocabulary) for t in texts], pa.int64())

    text = F.coalesce("text", F.lit(""))
    counted = small_batches(documents).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
