"""Byte-level BPE: texts to token ids and back, with a local rank file.

The ranks are read once per Python worker from ``rank_file`` (a path every executor has, or a
file name of the installed ``public_tokenizers``). Long texts are cut before encoding at places
where the pre-splitting pattern starts a new match whatever stands around: before a single space
between two characters that are not white space. Ids of the parts then join to the ids of the
whole. Runs of one kind longer than a part are left whole and cost the library's time for them.

Nulls in ``text`` count as empty (no ids); a null or repeated doc_id is carried along; other
columns stay untouched unless they have the names of the added ones, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import small_batches

RANK_FILE = "byte_bpe_50k.tiktoken"
PART_CHARS = 1 << 15
#: A single space with no white space on either side.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def resolve(rank_file: str) -> str:
    import public_tokenizers

    return rank_file if "/" in rank_file else public_tokenizers.path(rank_file)


@lru_cache(maxsize=4)
def codec(rank_file: str):
    import public_tokenizers
    import tiktoken

    with open(resolve(rank_file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut only at safe boundaries."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, rank_file: str = RANK_FILE, most: int = PART_CHARS) -> list[int]:
    encoding = codec(rank_file)
    if len(text) <= most:
        return encoding.encode_ordinary(text)
    return [i for part in safe_parts(text, most) for i in encoding.encode_ordinary(part)]


def decode(ids, rank_file: str = RANK_FILE) -> bytes:
    """The bytes of the ids; they may end within a character, so no text is promised."""
    return codec(rank_file).decode_bytes([int(i) for i in ids])


def encode_texts(documents: DataFrame, text: str = "text", ids: str = "ids", rank_file: str = RANK_FILE) -> DataFrame:
    """Adds the token ids of ``text`` as array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        parts = [np.asarray(encode(t.as_py() or "", rank_file), np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))

    return documents.withColumn(ids, ids_of(F.col(text)))


def decode_ids(encoded: DataFrame, ids: str = "ids", data: str = "data", rank_file: str = RANK_FILE) -> DataFrame:
    """Adds the bytes of the ids as binary. Null ids, and ids of no token, give null."""

    def one(values) -> bytes | None:
        try:
            return None if values is None or None in values else decode(values, rank_file)
        except KeyError:
            return None

    @F.arrow_udf(T.BinaryType())
    def bytes_of(lists: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in lists.to_pylist()], pa.binary())

    return encoded.withColumn(data, bytes_of(F.col(ids)))


def digests(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without moving the ids out of the task."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def digest(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            ids = encode(text.as_py() or "", rank_file)
            packed = np.asarray(ids, "<u4").tobytes()
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode(ids, rank_file)).hexdigest()))
        counts, of_ids, of_data = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_data, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(documents).select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def encoded_documents(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the text's bytes."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])

    @F.arrow_udf(kind)
    def both(texts: pa.Array) -> pa.Array:
        parts, exact = [], []
        for text in texts:  # ids as numbers of four bytes, one text at a time
            text = text.as_py() or ""
            ids = encode(text, rank_file)
            exact.append(codec(rank_file).decode_bytes(ids) == text.encode())
            parts.append(np.asarray(ids, np.int32))
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))
        return pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], ["ids", "exact"])

    encoded = small_batches(documents).select("doc_id", "lang", "source", both("text").alias("e"))
    return encoded.select("doc_id", "lang", "source", F.size("e.ids").cast("long").alias("n_tokens"), "e.ids", "e.exact")
