"""Words of many texts at once: byte offsets and 64-bit hashes, with numpy over Arrow buffers.

Hashes depend on the bytes of a word alone, so tasks on any machine agree on them. Work is cut
into pieces of bounded size; a single text is never cut where a word would be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that are hashed in one step; 8 times as many bytes are held meanwhile.
HASH_BYTES = 1 << 19
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20
U64 = np.uint64
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def not_spaces() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Byte table of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, a-z and all that is not ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; the powers of the base and of its inverse."""
    powers = np.full(HASH_BYTES + 1, _BASE)
    powers[0] = 1
    inverse = np.full(HASH_BYTES + 1, U64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    return mix(np.arange(1, 257, dtype=U64)), np.cumprod(powers), np.cumprod(inverse)


def _hash_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words of a short span, by differences of prefix sums."""
    of_byte, powers, inverse = _tables()
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(of_byte[data] * powers[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def _hash_long(data: np.ndarray) -> np.uint64:
    """The same hash for one word of any length."""
    total, scale = U64(0), U64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), HASH_BYTES):
            part = data[at : at + HASH_BYTES]
            total = total + scale * _hash_span(part, np.array([0]), np.array([len(part)]))[0]
            scale = scale * _tables()[1][len(part)]
    return total


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[starts[i]:ends[i]]`` (in order, without overlaps)."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        stop = int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right"))
        if stop <= at:  # one very long word
            out[at] = _hash_long(data[starts[at] : ends[at]])
            at += 1
            continue
        low = starts[at]
        out[at:stop] = _hash_span(data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return mix(out ^ _STEP)


def rolling(hashes: np.ndarray, offsets: list[int] | range, salt: int = 0) -> np.ndarray:
    """Hash of the words at the given offsets after each word, for each start that has them all."""
    width = max(offsets) + 1
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, mix(np.array([salt + 1], U64))[0])
    with np.errstate(over="ignore"):
        for k, offset in enumerate(offsets):
            total += hashes[offset : offset + n] * U64(pow(int(_STEP), k + 1, 1 << 64))
    return mix(total)


class Words:
    """The words of a list of texts; words ``first[i]`` to ``first[i + 1]`` are those of text i."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool = False, hashed: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
        self.bounds = offsets - offsets[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        self.data = data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = is_word[data]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        cuts = self.bounds[:-1][self.bounds[:-1] < len(data)]
        begins[cuts] = inside[cuts]
        stops = inside[:-1] & ~inside[1:]
        cuts = cuts[cuts > 0] - 1
        stops[cuts] = inside[cuts]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.hashes = hash_words(data, self.starts, self.ends) if hashed else None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, width: int) -> np.ndarray:
        """The words at which a window of so many words of one text starts."""
        at = np.arange(max(0, len(self.starts) - width + 1))
        return at[self.first[1:][self.owner()[at]] - at >= width] if len(at) else at


def spans(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text together; one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most_bytes, "right")))
        yield at, stop
        at = stop


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes of text."""
    for batch in batches:
        for low, high in spans(batch.column(column), most_bytes):
            yield batch.slice(low, high - low)


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """The same rows. Texts go to Python in batches of ``most`` bytes from here on in this session,
    unless it is set to less: batches of many rows of long texts need memory on both sides."""
    conf = df.sparkSession.conf
    if int(str(conf.get(BATCH_CONF)).rstrip("b")) > most:
        conf.set(BATCH_CONF, str(most))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids belong to no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
