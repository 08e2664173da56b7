"""Reproducible splits. All depend on a row key and a seed, never on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.stats import digest_limit, digest_number, key_digest
from eventloom.operators.ordering import HOT_ROWS, group_key, number_rows
from eventloom.schemas import LABEL
from eventloom.session import materialize

_DIGEST = "__digest"
# Hex digits by which a digest range is cut at a time; the rows of a range that are then listed.
_DIGITS = 3
_FEW_ROWS = 256
# Lists of class edges up to this length are broadcast.
_MAX_EDGES = 100_000


def with_test_flag(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: true for a ``test`` share of the keys."""
    first_digits = F.substring(key_digest(key, seed), 1, 8)
    return df.withColumn("is_test", first_digits < F.lit(digest_limit(test)))


def holdout_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test), each a filter on the table."""
    flagged = with_test_flag(df, key, test, seed)
    return (
        flagged.where(~F.col("is_test")).drop("is_test"),
        flagged.where(F.col("is_test")).drop("is_test"),
    )


def random_split(
    df: DataFrame, key: str, weights: Sequence[float] = (0.7, 0.3), seed: int = 0
) -> list[DataFrame]:
    """One part per weight, disjoint and covering, in the shares of the weights."""
    total, edge, edges = sum(weights), 0.0, [0]
    for weight in weights:
        edge += weight / total
        edges.append(round(edge * 2**32))
    edges[-1] = 2**32
    number = digest_number(key_digest(key, seed))
    return [df.where((number >= low) & (number < high)) for low, high in zip(edges, edges[1:])]


def stratified_folds(
    df: DataFrame, key: str, k: int, label: str = LABEL, seed: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``fold`` 0..k-1; within a class, fold sizes differ by at most one row."""
    shuffled = df.withColumn(_DIGEST, key_digest(key, seed))
    # Digests are uniform: equal parts of their range hold equal numbers of rows.
    numbered = number_rows(
        shuffled,
        [label],
        [_DIGEST, key],
        "__seq",
        hot_rows,
        range_of=lambda n: F.shiftright(digest_number(F.col(_DIGEST)) * n, 32).cast("int"),
    )
    return numbered.withColumn("fold", (F.col("__seq") % k).cast("int")).select(*df.columns, "fold")


def hashed_folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0..k-1 by hash alone: no shuffle, classes balanced in expectation."""
    fold = F.pmod(digest_number(key_digest(key, seed)), F.lit(k)).cast("int")
    return df.withColumn("fold", fold)


def quantile_folds(
    df: DataFrame, key: str, k: int, label: str = LABEL, seed: int = 0, few_rows: int = _FEW_ROWS
) -> DataFrame:
    """Add ``fold`` 0..k-1: each class in the order of its digests, cut into k parts.

    Sizes of a class's folds differ by at most one row. The exact edges of all classes are found together by
    counting: rows per class and first digits of the digest, then, inside the ranges that hold
    an edge, by the next digits, until a range has ``few_rows`` rows, whose digests are listed.
    The result is a projection of ``df`` with the edges: no row is sorted or shuffled. ``df`` is
    read some four times, its key and class only; pass a stored table.
    """
    if k == 1:
        return df.withColumn("fold", F.lit(0))
    rows = df.select(group_key([label]).alias("g"), key_digest(key, seed).alias("digest"), F.col(key).alias("key"))
    counts = materialize(_counted(rows, 0), "fold-counts")
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    # The first total % k folds have one row more.
    edge = F.expr(f"fold * (total div {k}) + least(fold, total % {k})")
    wanted = totals.select("g", F.explode(F.lit(list(range(1, k)))).alias("fold"), "total")
    edges = wanted.select("g", "fold", edge.alias("rank"), F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    known = 0
    while True:
        edges = materialize(_narrowed(edges, counts), "fold-edges")
        known += _DIGITS
        most = edges.agg(F.max("n")).first()[0] or 0
        if most <= few_rows or known + _DIGITS > 32:
            break
        counts = materialize(_counted(_inside(rows, edges, known), known), "fold-counts")
    listed = _inside(rows, edges, known).groupBy("g", "prefix").agg(F.array_sort(F.collect_list(F.struct("digest", "key"))).alias("rows"))
    at = edges.join(listed, ["g", "prefix"]).select("g", "fold", F.element_at("rows", (F.col("rank") - F.col("below")).cast("int")).alias("edge"))
    cuts = materialize(at.groupBy("g").agg(F.collect_list("edge").alias("edges")), "fold-cuts")
    cuts = F.broadcast(cuts) if cuts.count() * k <= _MAX_EDGES else cuts
    row = F.struct(key_digest(key, seed).alias("digest"), F.col(key).alias("key"))
    passed = F.size(F.filter(F.coalesce("edges", F.array()), lambda e: e < row)).cast("int")
    return df.withColumn("__g", group_key([label])).join(cuts, F.col("__g") == F.col("g"), "left").select(*df.columns, passed.alias("fold"))


def _counted(rows: DataFrame, known: int) -> DataFrame:
    """Rows per class and the first ``known`` digits and a few more."""
    return rows.groupBy("g", F.substring("digest", 1, known + _DIGITS).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def _narrowed(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Each edge with the longer prefix that its row has, and the rows of the class below that."""
    known: Column = F.expr(f"substring(prefix, 1, length(prefix) - {_DIGITS})")
    # A window has at most 16 to the power of the digits rows.
    before = W.partitionBy("g", known).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.select("g", known.alias("known"), F.col("prefix").alias("longer"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    joined = edges.select("g", "fold", "rank", F.col("prefix").alias("known"), "below").join(ranges, ["g", "known"])
    below = F.col("below") + F.col("earlier")
    return joined.where((below < F.col("rank")) & (F.col("rank") <= below + F.col("n"))).select("g", "fold", "rank", F.col("longer").alias("prefix"), below.alias("below"), "n")


def _inside(rows: DataFrame, edges: DataFrame, known: int) -> DataFrame:
    """The rows whose class and first digits have an edge."""
    ranges = materialize(edges.select("g", "prefix").distinct(), "fold-ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= _MAX_EDGES else ranges
    return rows.withColumn("prefix", F.substring("digest", 1, known)).join(ranges, ["g", "prefix"])
