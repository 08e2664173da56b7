"""Repeated passages across documents, by prefix-partitioned suffix trees over words.

The suffixes of all documents (one starts at every word that has ``width`` words from it on) are
split by a prefix of variable length: as many leading words as it takes until the prefix is
expected to be rarer than a quarter of a group, from the frequencies of words counted over all
documents. A rare first word is prefix enough; common words need several. The prefix says in
which of the memory-sized groups a suffix belongs, so equal windows meet in one group, and no
common word makes a group large. Each group then builds its subtrees in one sort: suffixes in
order of the fingerprint of their first ``width`` words, neighbours with equal fingerprints being
the leaves below one internal node of that depth. A node's leaves in documents other than the
node's smallest doc_id are repeats; where they follow each other in a document they merge into
maximal repeats.

Fingerprints have 64 bits beside the prefix that chose the group, so at 10^13 words in 10^7
groups about one false match is expected.

Before suffixes are sent off, equal windows of one piece of a task are joined: only those in the
piece's smallest doc_id are undecided, the others are repeats already. So a passage in a third of
all documents reaches its group once per piece, not once per document.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words. A row with a null doc_id is neither
smaller nor larger than others: it stays whole and makes nothing a repeat. Rows with the same
doc_id are not smaller than each other; they are told apart by a hash of their text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import _STEP, Words, mix, not_spaces, pieces, small_batches, spans
from eventloom.session import materialize

WIDTH = 13
#: Suffixes of a group, about; a group is sorted in memory.
GROUP = 1_000_000
#: Text of one piece, within which equal windows are joined before they are sent.
PIECE_BYTES = 4 << 20
#: Word frequencies are counted in so many classes of word hashes.
CLASSES = 4096
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
U64 = np.uint64


def word_frequencies(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Words of all documents by class of their hash: a vector of fixed length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for piece in pieces(batches, PIECE_BYTES):
            words = Words(piece.column("text"), not_spaces())
            total += np.bincount((words.hashes >> U64(52)).astype(np.int64), minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    sums = documents.select(F.col(text).alias("text")).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES, np.int64)
    for row in sums.collect():  # at most CLASSES rows
        counts[row.at] = row.n
    return counts


def prefix_groups(words: Words, at: np.ndarray, shares: np.ndarray, limit: float, groups: int, width: int) -> np.ndarray:
    """The group of the suffixes that start at the given words.

    A prefix grows word by word until its words' shares multiply to ``limit`` or less.
    """
    share = shares[(words.hashes >> U64(52)).astype(np.int64)]
    expected, code = np.ones(len(at)), np.zeros(len(at), U64)
    growing = np.arange(len(at))
    for k in range(width):
        word = at[growing] + k
        code[growing] += words.hashes[word] * U64(pow(int(_STEP), 2 * k + 1, 1 << 64))
        expected[growing] *= share[word]
        growing = growing[expected[growing] > limit]
        if not len(growing):
            break
    return (mix(code) % U64(groups)).astype(np.int64)


def _windows(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows at the given words."""
    n = max(0, len(words.hashes) - width + 1)
    total = np.full(n, U64(0x2545F4914F6CDD1D))
    for k in range(width):
        total += words.hashes[k : k + n] * U64(pow(int(_STEP), k + 1, 1 << 64))
    return mix(total)[at]


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[: n * width].reshape(width, n).T).view(kind).ravel()


def _pack(ids: np.ndarray, hashes: np.ndarray, row: np.ndarray, place: np.ndarray, keys: np.ndarray) -> bytes:
    """Suffixes in order of (row, place): rows (id, hash of text, number), places and fingerprints.

    ``keys`` is empty for repeats that are decided already.
    """
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    of_row = row[heads]
    counts = np.diff(np.append(heads, len(row))).astype("<u4")
    steps = np.diff(place, prepend=0).astype("<i4")
    steps[heads] = place[heads]
    id_steps = np.diff(ids[of_row], prepend=0).astype("<i8")
    parts = [np.array([len(heads), len(row), len(keys)], "<i8").tobytes(), _planes(id_steps), _planes(hashes[of_row].astype("<i4")), _planes(counts), _planes(steps.astype("<u4"))]
    return zstandard.compress(b"".join(parts), 1) + keys.astype("<u8").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, hash of text, place, fingerprint) of each suffix."""
    press = zstandard.ZstdDecompressor().decompressobj()
    data = press.decompress(blob)
    rows, n, with_keys = np.frombuffer(data[:24], "<i8")
    at, columns = 24, []
    for kind, size in (("<i8", rows), ("<i4", rows), ("<u4", rows), ("<u4", n)):
        length = int(size) * np.dtype(kind).itemsize
        columns.append(_from_planes(data[at : at + length], kind, int(size)))
        at += length
    id_steps, hashes, counts, steps = columns
    ids = np.repeat(np.cumsum(id_steps), counts)
    heads = np.cumsum(counts) - counts
    sums = np.cumsum(steps.astype(np.int64))
    before = sums[heads.astype(np.int64)] - steps[heads.astype(np.int64)] if len(heads) else sums
    places = sums - np.repeat(before, counts)
    return ids, np.repeat(hashes, counts), places, np.frombuffer(press.unused_data, "<u8") if with_keys else np.empty(0, U64)


def _send(piece: pa.RecordBatch, shares: np.ndarray, limit: float, groups: int, width: int) -> Iterator[tuple[int, bytes]]:
    """(group, suffixes) of a piece: undecided ones with fingerprints, decided repeats without."""
    words = Words(piece.column("text"), not_spaces())
    ids = piece.column("doc_id").to_numpy()
    hashes = piece.column("h").to_numpy()
    at = words.windows(width)
    if not len(at):
        return
    keys = _windows(words, at, width)
    row = words.owner()[at]
    place = at - words.first[row]
    # Equal windows of the piece: those of its smallest id stay undecided.
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    least = np.minimum.reduceat(ids[row][order], np.flatnonzero(new))
    undecided = np.empty(len(at), bool)
    undecided[order] = ids[row][order] == least[np.cumsum(new) - 1]
    group = prefix_groups(words, at, shares, limit, groups, width)
    for chosen, with_keys in ((undecided, True), (~undecided, False)):
        index = np.flatnonzero(chosen)
        index = index[np.argsort(group[index], kind="stable")]
        cuts = np.flatnonzero(np.diff(group[index])) + 1
        for part in np.split(index, cuts):
            if len(part):
                yield int(group[part[0]]), _pack(ids, hashes, row[part], place[part], keys[part] if with_keys else np.empty(0, U64))


def _repeats_of(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which suffixes of a group are below a node that has a leaf in a smaller id."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(ids), bool)
    out[order] = ids[order] > least[np.cumsum(new) - 1]
    return out


def repeated_windows(documents: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(bucket, repeats): lists of repeated windows, all those of a row in one bucket.

    documents: doc_id, text and h, the hash of the text that tells rows of one id apart.
    """
    counts = word_frequencies(documents)
    total = int(counts.sum())
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, math.ceil(total / group))
    shares, limit = counts / max(1, total), 1 / (4 * groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            found = list(_send(piece, shares, limit, groups, width))
            yield pa.record_batch({"g": pa.array([g for g, _ in found], pa.int64()), "suffixes": pa.array([s for _, s in found], pa.binary())})

    def subtrees(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(blob) for blob in rows["suffixes"]]
        known = [p for p in parts if not len(p[3])]
        open_ = [p for p in parts if len(p[3])]
        if open_:
            ids, hashes, places, keys = (np.concatenate(c) for c in zip(*open_))
            again = _repeats_of(ids, keys)
            known.append((ids[again], hashes[again], places[again], None))
        ids, hashes, places = (np.concatenate(c) for c in list(zip(*known))[:3])
        bucket = (mix(ids.view(U64) + U64(3)) % U64(groups)).astype(np.int64)
        order = np.lexsort((places, hashes, ids, bucket))
        ids, hashes, places, bucket = ids[order], hashes[order], places[order], bucket[order]
        row = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])])) if len(ids) else ids
        first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0])) if len(ids) else ids
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        parts, at = [], 0
        for end in ends if len(ids) else []:
            part = slice(at, end)
            parts.append((int(bucket[at]), _pack(ids[first], hashes[first], row[part], places[part], np.empty(0, U64))))
            at = end
        return pd.DataFrame({"bucket": np.array([b for b, _ in parts], np.int64), "repeats": [r for _, r in parts]})

    known = documents.filter("doc_id is not null and text is not null").select("doc_id", "text", "h")
    sent = known.mapInArrow(send, "g long, suffixes binary")
    return sent.groupBy("g").applyInPandas(subtrees, "bucket long, repeats binary")


def _spans(places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeats (first word, end) that windows at these places make; places are in order."""
    new = np.concatenate([[True], np.diff(places) > width])
    last = np.concatenate([new[1:], [True]])
    return places[new], places[last] + width


def maximal_repeats(documents: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(doc_id, h, starts, ends), stored: the repeated stretches, in words, of each row that has any.

    Windows that overlap or touch are one stretch.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ids, hashes, places = (np.concatenate(c) for c in list(zip(*map(_unpack, rows["repeats"])))[:3])
        order = np.lexsort((places, hashes, ids))
        ids, hashes, places = ids[order], hashes[order], places[order]
        heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
        found = [_spans(part, width) for part in np.split(places, heads[1:])]
        return pd.DataFrame({"doc_id": ids[heads], "h": hashes[heads], "starts": [s for s, _ in found], "ends": [e for _, e in found]})

    windows = repeated_windows(documents, width, group)
    return materialize(windows.groupBy("bucket").applyInPandas(merge, "doc_id long, h int, starts array<long>, ends array<long>"), "repeats")


DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _kept(text: str | None, starts, ends) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    if not starts:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for s, e in zip(starts, ends):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def without_repeats(documents: DataFrame, width: int = WIDTH, group: int = GROUP, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (its SHA-256 as kept_sha256 with ``digest``).

    Rows without repeats are finished where they are read: a bit map of bounded size says which
    rows may have some, and only those are shuffled to meet theirs.
    """
    keyed = small_batches(documents).select("doc_id", "text", F.hash("text").alias("h"))
    repeats = maximal_repeats(keyed, width, group)
    n, bits = repeats.count(), LEAST_BITS
    while bits < min(32 * n, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id", "h"), F.lit(bits))
    words = repeats.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    table = np.zeros(bits >> 6, U64)
    for batch in words.select("at", "word").toArrow().to_batches():
        table[batch.column("at").to_numpy()] = batch.column("word").to_numpy().view(U64)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.BooleanType())
    def may_repeat(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1)

    def finish(texts: pa.Array, starts: pa.Array | None, ends: pa.Array | None) -> pa.Array:
        rows = []
        for low, high in spans(texts, PIECE_BYTES):
            size = high - low
            a, b = (c.slice(low, size).to_pylist() if c is not None else [None] * size for c in (starts, ends))
            for text, s, e in zip(texts.slice(low, size).to_pylist(), a, b):
                n_words, removed, kept = _kept(text, s, e)
                rows.append((n_words, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], DIGEST.names)

    @F.arrow_udf(DIGEST)
    def whole(texts: pa.Array) -> pa.Array:
        return finish(texts, None, None)

    @F.arrow_udf(DIGEST)
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return finish(texts, starts, ends)

    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    marked = keyed.withColumn("may", F.when(known, may_repeat(place)).otherwise(False))
    same = (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("d.h") == F.col("r.h"))
    met = marked.filter("may").alias("d").join(repeats.alias("r"), same, "left").select("d.doc_id", "d.text", "r.starts", "r.ends")
    out = marked.filter("not may").select("doc_id", whole("text").alias("k")).union(met.select("doc_id", cut("text", "starts", "ends").alias("k")))
    return out.select("doc_id", "k.n_words", "k.n_removed", F.col("k.kept").alias("kept_sha256" if digest else "text"))
