"""Benchmark passages in texts, found by spaced seeds and verified allowing for substitutions.

A seed is a fixed mask over consecutive words: the words at its ones are hashed, those at its
zeros are not looked at, so a changed word at a zero leaves the hash alone. Hashes of all masks
at all words of a text are joined with those of the benchmark items. A hit says that word p of
the text stands opposite word q of the item; around it, text and item are compared word by word
on that diagonal, and the longest stretch with at least ``SIMILARITY`` equal words decides. It
begins and ends in an equal word, or where the item does, with changed words too. A
stretch counts from ``MIN_WORDS`` words on (all the item's, if it has fewer). Every stretch that
counts is hit: wherever its changed words are, the ones of some mask fall on equal words. Items
with fewer words than ``SHORTEST`` tell nothing of a leak and match nothing.

Before the join, hashes are looked up in a bit map of the benchmark's. Its size follows the
benchmark up to ``MOST_BITS``; beyond, more hashes pass it and the join drops them. Words are
runs of letters and digits in lower case. Nulls count as empty; null and repeated doc_ids, items
and further columns do no harm: rows are told apart by a number of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import Words, letters_and_digits, rolling, small_batches, spans
from eventloom.session import materialize

#: Fixed masks: six words of at most eight. A row of words in which none of them finds six equal ones
#: has less than ``SIMILARITY`` equal words from ``SHORTEST`` words on (the tests enumerate it).
MASKS = ["111111", "1111101", "1111011", "1110111", "11100111", "11011011", "11010111"]
MIN_WORDS = 13
SHORTEST = 8
SIMILARITY = 0.8
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30
#: Seeds up to this number are broadcast (24 bytes each); more are joined by a salted shuffle.
BROADCAST_SEEDS = 1_000_000
SALTS = 16
PIECE_BYTES = 2 << 20

SEED = T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.IntegerType())])
SEEDS = T.StructType([T.StructField("words", T.StringType()), T.StructField("seeds", T.ArrayType(SEED))])


def _seeds(words: Words):
    """(hash, first word) of every mask at every place where it fits into one text."""
    for n, mask in enumerate(MASKS):
        at = words.windows(len(mask))
        yield rolling(words.hashes, [i for i, c in enumerate(mask) if c == "1"], salt=n)[at], at


def _bit_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(shift)) & np.uint64(bits - 1) for shift in (0, 17, 34)]


def _with_seeds(texts: pa.Array, passes) -> pa.Array:
    """The words of each text that has seeds that pass, and those seeds."""
    joined, rows = [], []
    for low, high in spans(texts, PIECE_BYTES):
        words = Words(texts.slice(low, high - low), letters_and_digits(), lower=True)
        owner, seeds = words.owner(), [[] for _ in range(len(words))]
        for hashes, at in _seeds(words):
            keep = passes(hashes)
            for h, i in zip(hashes[keep].view(np.int64).tolist(), at[keep].tolist()):
                seeds[owner[i]].append({"hash": h, "pos": i - int(words.first[owner[i]])})
        rows += seeds
        joined += [b" ".join(words.word(k) for k in range(words.first[i], words.first[i + 1])).decode() if s else None for i, s in enumerate(seeds)]
    of_seeds = pa.array(rows, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))
    return pa.StructArray.from_arrays([pa.array(joined, pa.string()), of_seeds], ["words", "seeds"])


@F.arrow_udf(SEEDS)
def _all_seeds(texts: pa.Array) -> pa.Array:
    return _with_seeds(texts, lambda hashes: np.ones(len(hashes), bool))


def benchmark_seeds(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(item, item_id, words, seeds) of the items long enough to tell a leak."""
    seeded = benchmark.select("item_id", _all_seeds(F.col(text)).alias("s")).select("item_id", F.split("s.words", " ").alias("words"), "s.seeds")
    return materialize(seeded.filter(F.size("words") >= SHORTEST).withColumn("item", F.monotonically_increasing_id()), "benchmark-seeds")


def _bitmap(seeds: DataFrame, n_seeds: int) -> tuple[int, np.ndarray]:
    """A bit map of the seeds' hashes, put together from distinct bits by Spark."""
    bits = LEAST_BITS
    while bits < min(64 * n_seeds, MOST_BITS):
        bits *= 2
    word_of = [F.shiftrightunsigned("hash", s).bitwiseAND(bits - 1) for s in (0, 17, 34)]
    words = seeds.select(F.explode(F.array(*word_of)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    table = np.zeros(bits >> 6, np.uint64)
    for batch in words.select("at", "word").toArrow().to_batches():
        table[batch.column("at").to_numpy()] = batch.column("word").to_numpy().view(np.uint64)
    return bits, table


def _longest_similar(equal: np.ndarray, similarity: float, from_start: bool = False, to_end: bool = False) -> tuple[int, int]:
    """The longest stretch with that share of equal words.

    It starts and ends in an equal word, or ``from_start`` at the first and ``to_end`` at the last word, equal or not.
    """
    if not equal.any():
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    opens, closes = equal.copy(), equal.copy()
    opens[0] |= from_start
    closes[-1] |= to_end
    ends = np.flatnonzero(closes) + 1
    lows = np.minimum.accumulate(np.where(opens, sums[:-1], np.inf))
    starts = np.minimum(np.searchsorted(-lows, -(sums[ends] + 1e-9), "left"), ends)
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


VERIFIED = T.StructType([T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_equal", T.LongType())])


def _verify(contexts: pa.Array, items: pa.Array, lefts: pa.Array) -> pa.Array:
    """Compares item words with the text's words opposite; ``lefts``: item words before the context."""
    rows = []
    for context, item, left in zip(contexts.to_pylist(), items.to_pylist(), lefts.to_pylist()):
        equal = np.array([a == b for a, b in zip(context, item[left:])], bool)
        # Where the item itself begins and ends, its changed words count as part of the stretch.
        start, end = _longest_similar(equal, SIMILARITY, left == 0, left + len(equal) == len(item))
        enough = end - start >= min(MIN_WORDS, len(item))
        rows.append((start, end - start, int(equal[start:end].sum())) if enough else (None, None, None))
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "n_words", "n_equal"])


def find_leaks(documents: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``documents`` and benchmark item found in it.

    Columns: ``keys`` (doc_id, by default), item_id, first_word (of the text, from 0), n_words and
    n_equal of the longest similar stretch, similarity = n_equal / n_words.
    """
    keys = keys or ["doc_id"]
    items = benchmark_seeds(benchmark, "text")
    seeds = items.select("item", F.inline("seeds")).withColumnRenamed("pos", "item_pos")
    n_seeds = seeds.count()
    bits, table = _bitmap(seeds, n_seeds)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def passes(hashes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(hashes), bool)
        for bit in _bit_of(hashes, bits):
            at = np.flatnonzero(keep)
            word = shared.value[(bit[at] >> np.uint64(6)).astype(np.int64)]
            keep[at] = (word >> (bit[at] & np.uint64(63))) & np.uint64(1) == 1
        return keep

    @F.arrow_udf(SEEDS)
    def passing_seeds(texts: pa.Array) -> pa.Array:
        return _with_seeds(texts, passes)

    looked_up = small_batches(documents).select(F.struct(*keys).alias("key"), passing_seeds(F.col(text)).alias("s")).filter(F.size("s.seeds") > 0)
    stored = materialize(looked_up.select("key", F.split("s.words", " ").alias("words"), "s.seeds").withColumn("row", F.monotonically_increasing_id()), "seed-hits")
    hits = stored.select("row", F.inline("seeds"))
    if n_seeds <= BROADCAST_SEEDS:
        met = hits.join(F.broadcast(seeds), "hash")
    else:  # a passage that a third of all texts have makes a hash hot
        hits = hits.withColumn("salt", F.pmod(F.hash("row", "pos"), F.lit(SALTS)))
        met = hits.join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "salt"])
    diagonals = met.select("row", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    in_item, in_text = F.greatest(-F.col("diagonal"), F.lit(0)), F.greatest(F.col("diagonal"), F.lit(0))
    with_text = diagonals.join(stored.select("row", "key", "words"), "row")
    item_words = items.select("item", "item_id", F.col("words").alias("item_words"))
    small = n_seeds <= BROADCAST_SEEDS  # then so are the items: a seed per mask and word
    opposite = with_text.join(F.broadcast(item_words) if small else item_words, "item")
    opposite = opposite.select("row", "key", "item", "item_id", in_text.alias("at"), in_item.alias("left"), "item_words", F.slice("words", in_text + 1, F.size("item_words") - in_item).alias("context"))
    verified = opposite.select("row", "key", "item", "item_id", "at", F.arrow_udf(_verify, VERIFIED)("context", "item_words", "left").alias("v")).filter(F.col("v.n_words").isNotNull())
    order = F.struct(F.col("v.n_equal"), -(F.col("at") + F.col("v.start")), F.col("v.n_words"))
    best = verified.groupBy("row", "item").agg(F.first("key").alias("key"), F.first("item_id").alias("item_id"), F.max_by(F.struct((F.col("at") + F.col("v.start")).alias("first_word"), "v.n_words", "v.n_equal"), order).alias("b"))
    return best.select("key.*", "item_id", "b.first_word", "b.n_words", "b.n_equal", (F.col("b.n_equal") / F.col("b.n_words")).alias("similarity"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text holds no benchmark passage (null texts stay).

    Leaking rows are named by their text, so the answer does not depend on how files are read.
    """
    keyed = documents.select(F.sha2("text", 256).alias("text_key"), "text")
    leaks = find_leaks(keyed, benchmark, ["text_key"]).select(F.col("text_key").alias("leak")).distinct()
    packed = documents.select(F.sha2("text", 256).alias("key"), F.struct("*").alias("doc"))
    return packed.join(leaks, F.col("key") == F.col("leak"), "left_anti").select("doc.*")
