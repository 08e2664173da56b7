"""Left lookups into dimension tables that broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.events import root_code
from eventloom.operators.ordering import HOT_ROWS, group_load, hot_marks

# A lookup table is broadcast up to this many rows and text bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 2**20

# Rows of one hot value are dealt out to at most this many tasks.
MAX_SALTS = 10_000

_FOUND, _SALT, _AT, _KEY = "__key", "__salt", "__salt_of", "__typed_key"


def measure(dim: DataFrame) -> list[Column]:
    """Aggregates ``n`` and ``bytes``: rows and approximate size of a table."""
    texts = [c for c, dtype in dim.dtypes if dtype == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(dim.columns)))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("bytes")]


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure whether a table may be broadcast."""
    size = dim.agg(*measure(dim)).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def lookup(
    df: DataFrame,
    dim: DataFrame,
    column: str,
    key: str,
    broadcast: bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``df[column]`` to the unique ``dim[key]``; null matches null.

    Whether a table may be broadcast, and whether its keys are unique, is measured unless
    ``broadcast`` says it. In a join by shuffle, rows of values above ``hot_rows`` rows are
    dealt out by a salt that each of those values' entries has in all its values, before
    any shuffle by value. The salt is a hash of the row, so a recomputed task deals as the lost one
    did. ``df`` is read two or three times then, for the counts and for the join.
    """
    if broadcast is None:
        broadcast = fits_broadcast(dim)
        repeated = dim.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise ValueError(f"{key} is not unique in the table that is looked up")
    dim = dim.withColumnRenamed(key, _FOUND)
    matched = F.col(column).eqNullSafe(F.col(_FOUND))
    if broadcast:
        return df.join(F.broadcast(dim), matched, "left").drop(_FOUND)
    # A stream cannot be counted beforehand.
    load = None if df.isStreaming else group_load(df, [column])
    if load is None or load.largest <= hot_rows:
        return df.join(dim, matched, "left").drop(_FOUND)
    salts = min(MAX_SALTS, -(-load.largest // hot_rows))
    marks = hot_marks(df, [column], hot_rows, load)
    salt = F.when(F.col(_SALT), F.pmod(F.xxhash64(*df.columns), F.lit(salts))).otherwise(0)
    dealt = marks.mark(df, [column], _SALT).select(*df.columns, salt.alias(_SALT))
    # Keys are hashed as the column's type has them.
    typed = dim.withColumn(_KEY, F.col(_FOUND).cast(df.schema[column].dataType))
    every = F.when(F.col(_SALT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    entries = marks.mark(typed, [_KEY], _SALT).select(*dim.columns, F.explode(every).alias(_AT))
    joined = dealt.join(entries, matched & (F.col(_SALT) == F.col(_AT)), "left")
    return joined.drop(_FOUND, _SALT, _AT)


def describe_codes(
    events: DataFrame, codes: DataFrame, code: str = "CAMEOCode", broadcast: bool | None = None
) -> DataFrame:
    """Add the description of each event code and of its root; unknown codes get null."""
    if broadcast is None:
        broadcast = fits_broadcast(codes)
    roots = codes.where(F.length("code") == 2).withColumnRenamed("description", "root_description")
    described = lookup(events, codes, code, "code", broadcast)
    return (
        lookup(described.withColumn("__root", root_code(code)), roots, "__root", "code", broadcast)
        .drop("__root")
    )
