"""Row numbers and first-n rows without a single-task sort.

A window numbers each group in one task. That is right for small groups, and whether the
groups are small is looked up, not assumed. Groups above ``hot_rows`` rows are cut into
key ranges: split points come from a small hash sample of the order key, rows are numbered
inside (group, range), and the counts of the earlier ranges are added. The split points
are literals in the plan, so a recomputed task cuts where the lost one did.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import materialize

# Groups up to this size are sorted by one task.
HOT_ROWS = 5_000_000
# A list of up to this many hot groups is broadcast; a longer one is joined by shuffle.
MAX_HOT_GROUPS = 10_000
# Split points in one plan; a table that needs more is cut in two levels.
MAX_SPLITS = 16_384
# Second-level split points up to this number are broadcast.
MAX_POINTS = 1_000_000
# Groups are first counted by this many hash buckets.
BUCKETS = 1 << 18
_SAMPLE_FACTOR = 4
# Up to this many first rows are found by a plain top-n.
TOP_N = 10_000
# The range that holds the last of many first rows is narrowed down to this size.
SORT_ROWS = 100_000
_HASH_RANGE = 2**31

_GROUP, _RANGE, _RANK, _OFFSET, _COUNT, _IS_HOT = "__group", "__range", "__rank", "__offset", "__count", "__is_hot"
_BUCKET, _MARK, _MARKED, _COARSE, _POINTS = "__bucket", "__mark", "__marked", "__coarse", "__points"


@dataclass(frozen=True)
class GroupLoad:
    """Row count of a table, a bound of its largest group, and the stored row counts of buckets of groups."""

    total: int
    largest: int
    counts: DataFrame | None = None


def bucket(by: Sequence[str]) -> Column:
    """Which of ``BUCKETS`` a group is in: equal for equal groups, nulls included."""
    return F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).alias(_BUCKET)


def group_load(df: DataFrame, by: Sequence[str]) -> GroupLoad:
    """Counts the rows of buckets of groups, in one pass whose shuffle is bounded for every task.

    A group is no larger than its bucket, so groups in small buckets are known to be small, and
    no group's rows have to meet to learn that. The counts are stored.
    """
    if not by:
        total = df.count()
        return GroupLoad(total, total)
    counts = materialize(df.groupBy(bucket(by)).agg(F.count(F.lit(1)).alias(_COUNT)), "group-counts")
    row = counts.agg(F.sum(_COUNT).alias("total"), F.max(_COUNT).alias("largest")).first()
    return GroupLoad(row["total"] or 0, row["largest"] or 0, counts)


def _bucket_counts(df: DataFrame, by: Sequence[str], load: GroupLoad) -> DataFrame:
    return load.counts if load.counts is not None else group_load(df, by).counts


def hot_groups(df: DataFrame, by: Sequence[str], hot_rows: int, load: GroupLoad) -> DataFrame:
    """All groups above ``hot_rows`` rows, whatever the size of the table.

    Only the rows of large buckets are counted by group, and their counts shrink before they are shuffled. The
    list is broadcast if it has been counted to be short.
    """
    large = F.broadcast(_bucket_counts(df, by, load).where(F.col(_COUNT) > hot_rows).select(_BUCKET))
    rows = df.select(*by, bucket(by)).join(large, _BUCKET, "left_semi")
    hot = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(_COUNT)).where(F.col(_COUNT) > hot_rows).select(*by), "hot-groups")
    return F.broadcast(hot) if hot.count() <= MAX_HOT_GROUPS else hot


@dataclass(frozen=True)
class HotMarks:
    """What tells whether a row's group may be hot: a short list of groups, or else of buckets.

    Either is broadcast: rows are marked before anything is shuffled by group. The list of
    buckets is bounded by their number, and a mark on a group that is not hot does no harm.
    """

    table: DataFrame
    by_bucket: bool

    def mark(self, df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        """``df`` with a boolean column: whether the group of these columns is marked."""
        keys = df.withColumn(_MARK, F.struct(bucket(columns).alias("key")) if self.by_bucket else group_key_of(columns))
        marked = keys.join(F.broadcast(self.table), F.col(_MARK) == F.col(_MARKED), "left")
        return marked.select(*df.columns, F.col(_MARKED).isNotNull().alias(name))


def group_key_of(columns: Sequence[str]) -> Column:
    """A group's key whatever its columns are called; never null."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def hot_marks(df: DataFrame, by: Sequence[str], hot_rows: int, load: GroupLoad) -> HotMarks:
    large = _bucket_counts(df, by, load).where(F.col(_COUNT) > hot_rows)
    # Each large bucket has few hot groups; more large buckets than the list may have need no counting.
    if large.count() <= MAX_HOT_GROUPS:
        hot = hot_groups(df, by, hot_rows, load)
        if hot.count() <= MAX_HOT_GROUPS:
            return HotMarks(hot.select(group_key_of(by).alias(_MARKED)), False)
    return HotMarks(large.select(F.struct(F.col(_BUCKET).alias("key")).alias(_MARKED)), True)


def group_key(by: Sequence[str]) -> Column:
    """One never-null column that equals for equal groups, nulls included."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


@dataclass(frozen=True)
class KeyRanges:
    """Sorted split points over the order columns, as literals.

    Keys and points are compared column by column, nulls first, as a sort does. Points are
    text; a timestamp's is its microseconds since 1970, as local times are not unique.
    """

    order: tuple[str, ...]
    types: tuple[T.DataType, ...]
    points: tuple[tuple[str | None, ...], ...]

    def index(self) -> Column:
        """Number of split points at or below the row's key, by binary search."""
        if not self.points:
            return F.lit(0)
        parts = [
            _typed(F.from_json(F.lit(json.dumps([p[i] for p in self.points])), "array<string>"), dtype)
            for i, dtype in enumerate(self.types)
        ]
        steps = F.lit([1 << i for i in reversed(range(len(self.points).bit_length()))])

        def step_up(low: Column, step: Column) -> Column:
            middle = low + step
            # Past the last point there is none to be at or below the key.
            inside = middle <= len(self.points)
            reached = self._reached([F.get(part, middle - 1) for part in parts], True)
            return F.when(inside & reached, middle).otherwise(low)

        return F.aggregate(steps, F.lit(0), step_up)

    def from_point(self, i: int) -> Column:
        """Whether the row's key is at or after point ``i``."""
        return self._reached(self._point(i), True) & self._first_column(i, after=True)

    def before_point(self, i: int) -> Column:
        return ~self._reached(self._point(i), True) & self._first_column(i, after=False)

    def at_point(self, i: int) -> Column:
        same = F.lit(True)
        for column, value in zip(self.order, self._point(i)):
            same = same & F.col(column).eqNullSafe(value)
        return same

    def _point(self, i: int) -> list[Column]:
        return [F.get(_typed(F.array(F.lit(v)), dtype), F.lit(0)) for v, dtype in zip(self.points[i], self.types)]

    def _reached(self, point: Sequence[Column], if_equal: bool) -> Column:
        """Whether the row's key is after the point, or ``if_equal`` where they are the same."""
        reached = F.lit(if_equal)
        for i, (column, value) in reversed(list(enumerate(zip(self.order, point)))):
            key = F.col(column)
            after = value < key
            if any(p[i] is None for p in self.points):
                after = after | (value.isNull() & key.isNotNull())
            reached = F.when(after, F.lit(True)).when(value.eqNullSafe(key), reached).otherwise(F.lit(False))
        return reached

    def _first_column(self, i: int, after: bool) -> Column:
        """What the comparison says of the first column alone: a condition file scans can use."""
        if self.points[i][0] is None:
            return F.lit(True)
        first, bound = F.col(self.order[0]), self._point(i)[0]
        return first >= bound if after else first.isNull() | (first <= bound)


def _text(column: str, dtype: T.DataType) -> Column:
    return (F.unix_micros(column) if isinstance(dtype, T.TimestampType) else F.col(column)).cast("string").alias(column)


def _typed(texts: Column, dtype: T.DataType) -> Column:
    """An array of points as text, in the order column's type."""
    if isinstance(dtype, T.TimestampType):
        return F.transform(texts.cast("array<bigint>"), F.timestamp_micros)
    return texts.cast(T.ArrayType(dtype))


def key_ranges(df: DataFrame, order: Sequence[str], total: int, splits: int) -> KeyRanges:
    """At most ``splits`` split points, drawn by hash so that every run draws the same ones.

    The sample only places the cuts; no row depends on being in it. It is several times
    larger than needed, which evens out the ranges between every few of its keys.
    """
    if any(df.schema[c].dataType == T.BinaryType() for c in order):
        raise ValueError("binary order columns cannot be split; order by their hex text")
    wanted = max(_SAMPLE_FACTOR * splits, 100)
    share = min(_HASH_RANGE, int(_HASH_RANGE * wanted / max(total, 1)) + 1)
    sample = (
        df.select(*order)
        .where(F.pmod(F.xxhash64(*order), F.lit(_HASH_RANGE)) < share)
        .distinct()
        .limit(2 * wanted)
        .orderBy(*order)
        .select(*[_text(c, dtype) for c, dtype in zip(order, _types(df, order))])
        .collect()
    )
    step = -(-len(sample) // splits) or 1
    points = tuple(tuple(p) for p in sample[step - 1 :: step])
    return KeyRanges(tuple(order), _types(df, order), points)


def splits_for(total: int, hot_rows: int) -> int:
    """Ranges a quarter the size of what one task may sort, up to ``MAX_SPLITS`` of them."""
    return max(2, min(MAX_SPLITS, -(-4 * total // max(hot_rows, 1))))


def _types(df: DataFrame, order: Sequence[str]) -> tuple[T.DataType, ...]:
    return tuple(df.schema[c].dataType for c in order)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "seq",
    hot_rows: int = HOT_ROWS,
    load: GroupLoad | None = None,
    range_of: Callable[[int], Column] | None = None,
) -> DataFrame:
    """Append the 0-based position of each row in its group; ``order`` must be unique in a group.

    ``range_of(n)`` may give the number 0..n-1 of a row's range, if the order is known to fall
    into even ranges; otherwise ranges are found from a sample.
    """
    load = load or group_load(df, by)
    if load.largest <= hot_rows:
        position = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return df.withColumn(name, (position - 1).cast("bigint"))

    ranged = materialize(_with_ranges(df, by, order, hot_rows, load, range_of), "ranged-rows")
    counts = ranged.groupBy(_GROUP, _RANGE).agg(F.count(F.lit(1)).alias(_COUNT))
    # A group has at most one row per range here, so this window is small.
    earlier = W.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        _GROUP, _RANGE, F.coalesce(F.sum(_COUNT).over(earlier), F.lit(0)).alias(_OFFSET)
    )
    rank = F.row_number().over(W.partitionBy(_GROUP, _RANGE).orderBy(*order))
    return (
        ranged.withColumn(_RANK, rank)
        .join(offsets, [_GROUP, _RANGE])
        .withColumn(name, (F.col(_OFFSET) + F.col(_RANK) - 1).cast("bigint"))
        .select(*df.columns, name)
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "so_far",
    hot_rows: int = HOT_ROWS,
    load: GroupLoad | None = None,
) -> DataFrame:
    """Append the sum of ``value`` over the rows of the group up to this one, those that tie with it included."""
    load = load or group_load(df, by)
    so_far = lambda keys: F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rangeBetween(W.unboundedPreceding, 0))
    if load.largest <= hot_rows:
        return df.withColumn(name, so_far(by))
    # Rows that tie have one key and so one range.
    ranged = materialize(_with_ranges(df, by, order, hot_rows, load, None), "ranged-rows")
    sums = ranged.groupBy(_GROUP, _RANGE).agg(F.sum(value).alias(_COUNT))
    earlier = W.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(_GROUP, _RANGE, F.coalesce(F.sum(_COUNT).over(earlier), F.lit(0)).alias(_OFFSET))
    return (
        ranged.withColumn(_RANK, so_far([_GROUP, _RANGE]))
        .join(offsets, [_GROUP, _RANGE])
        .withColumn(name, F.col(_OFFSET) + F.col(_RANK))
        .select(*df.columns, name)
    )


def _with_ranges(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    hot_rows: int,
    load: GroupLoad,
    range_of: Callable[[int], Column] | None,
) -> DataFrame:
    """Add the group key and a range number, which is 0 for all groups but the hot ones."""
    keyed, columns = df.withColumn(_GROUP, group_key(by)), [*df.columns, _GROUP]
    if by:
        keyed = hot_marks(df, by, hot_rows, load).mark(keyed, by, _IS_HOT)
    wanted = max(2, -(-4 * load.total // max(hot_rows, 1)))
    if range_of:
        index = range_of(wanted)
    elif wanted <= MAX_SPLITS:
        index = key_ranges(df, order, load.total, wanted).index()
    else:
        keyed, index = _two_levels(keyed, order, load.total, wanted)
    # Never null: a nullable range would be computed once more, to filter the join's keys.
    ranged = F.when(F.col(_IS_HOT), index) if by else index
    return keyed.select(*columns, F.coalesce(ranged, F.lit(0)).cast("bigint").alias(_RANGE))


def _two_levels(df: DataFrame, order: Sequence[str], total: int, wanted: int) -> tuple[DataFrame, Column]:
    """The rows with the split points of their coarse range, and the number of their range.

    Coarse ranges are cut by points in the plan. Each is cut again by points from its own sample, kept
    in a table of a row per coarse range: however large the table, a range has one size.
    """
    coarse = df.withColumn(_COARSE, key_ranges(df, order, total, MAX_SPLITS).index())
    inner = -(-wanted // MAX_SPLITS)
    share = min(_HASH_RANGE, int(_HASH_RANGE * _SAMPLE_FACTOR * wanted / max(total, 1)) + 1)
    key = group_key_of(order)
    sample = coarse.where(F.pmod(F.xxhash64(*order), F.lit(_HASH_RANGE)) < share)
    sorted_keys = sample.groupBy(_COARSE).agg(F.array_sort(F.collect_set(key)).alias(_POINTS))
    # Every so-manieth key of the sample.
    points = F.filter(_POINTS, lambda p, i: (i + 1) % _SAMPLE_FACTOR == 0)
    cuts = materialize(sorted_keys.select(_COARSE, points.alias(_POINTS)), "range-points")
    cuts = F.broadcast(cuts) if 2 * inner * MAX_SPLITS <= MAX_POINTS else cuts
    reached = F.size(F.filter(F.coalesce(_POINTS, F.array()), lambda p: p <= key))
    return coarse.join(cuts, _COARSE, "left"), F.col(_COARSE).cast("bigint") * F.lit(1 << 32) + reached


def head(
    df: DataFrame, order: Sequence[str], n: int, top_n: int | None = None, sort_rows: int | None = None
) -> DataFrame:
    """The first ``n`` rows by ``order``, in that order. Of rows that tie at the edge, any stay.

    Up to ``top_n`` rows are a top-n. For more, the order key of the last wanted row is
    narrowed down range by range until a range has ``sort_rows`` rows or few keys, and the
    result is a filter: the other columns are not shuffled to find it.
    """
    top_n, sort_rows = (TOP_N if top_n is None else top_n), (SORT_ROWS if sort_rows is None else sort_rows)
    if n <= top_n:
        return df.orderBy(*order).limit(n)
    keys, wanted = df.select(*order), n
    total = keys.count()
    if wanted >= total:
        return df.orderBy(*order)
    while total > sort_rows:
        ranges = key_ranges(keys, order, total, splits_for(total, sort_rows))
        sizes = keys.groupBy(ranges.index().alias("i")).agg(F.count(F.lit(1)).alias("n"))
        for row in sizes.orderBy("i").collect():
            if wanted <= row["n"]:
                break
            wanted -= row["n"]
        i, before, total = row["i"], total, row["n"]
        if i > 0:
            keys = keys.where(ranges.from_point(i - 1))
        if i < len(ranges.points):
            keys = keys.where(ranges.before_point(i))
        if total == before:
            break  # so few keys that none was drawn as a split point
    # One row per key: as many as ``sort_rows``, or the few keys that many rows share.
    so_far = F.sum(_COUNT).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    counts = keys.groupBy(*order).agg(F.count(F.lit(1)).alias(_COUNT)).withColumn(_OFFSET, so_far)
    reached = counts.where(F.col(_OFFSET) >= wanted).orderBy(_OFFSET)
    texts = [_text(c, dtype) for c, dtype in zip(order, _types(df, order))]
    *edge, count, offset = reached.select(*texts, _COUNT, _OFFSET).first()
    point = KeyRanges(tuple(order), _types(df, order), (tuple(edge),))
    wanted -= offset - count
    tied = df.where(point.at_point(0))
    if wanted < count:
        tied = _any_rows(tied, wanted, count, top_n, sort_rows)
    return df.where(point.before_point(0)).union(tied).orderBy(*order)


def _any_rows(tied: DataFrame, n: int, total: int, top_n: int, sort_rows: int) -> DataFrame:
    """``n`` of rows that tie, the first by a hash of the row; rows of one hash are taken as equal."""
    if n <= sort_rows:
        return tied.limit(n)
    hashed = tied.withColumn(_RANK, F.xxhash64(*tied.columns))
    if hashed.select(_RANK).distinct().limit(2).count() == 1:
        return tied.limit(n)
    return head(hashed, [_RANK], n, top_n, sort_rows).drop(_RANK)
