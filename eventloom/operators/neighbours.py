"""Mutual information of continuous features with a class, from nearest neighbours.

For each row and feature: the distance to the k-th nearest row of the same class, and how many
rows of any class are nearer than that. With digamma psi, the estimate is psi(rows) +
mean psi(k) - mean psi(rows of the class) - mean psi(rows so near), and 0 at least.

A feature is one dimension, so neighbours stand next to each other once values are in order.
Rows are numbered by (feature, class) in order; blocks of consecutive rows get the k rows before and
after them as a halo, and a window of 2k rows finds the distance. How many rows are near is the difference
of two ranks: the ends of a row's interval are put among the values and a running count
tells the values before them. Both run over key ranges, so no feature and no class is one task's,
and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.events import missing_as_null
from eventloom.functions.stats import digamma, digest_number, key_digest
from eventloom.operators.cleaning import feature_columns
from eventloom.operators.ordering import HOT_ROWS, number_rows, running_sum
from eventloom.schemas import LABEL
from eventloom.session import materialize

# Neighbours, and the noise as a share of a feature's size, of the estimator.
NEIGHBOURS = 3
NOISE = 1e-10
# Rows that one task gives their neighbours.
BLOCK_ROWS = 1_000_000
# A table of class sizes up to this many rows is broadcast.
MAX_CLASSES = 100_000


def neighbour_scores(
    df: DataFrame,
    key: str,
    label: str = LABEL,
    features: Sequence[str] | None = None,
    neighbours: int = NEIGHBOURS,
    seed: int = 0,
    noise: float | None = None,
    noise_bits: int = 32,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(feature, mi) in nats; features are taken as continuous.

    Equal values are told apart by a noise from a digest of seed and unique ``key``, below ``noise``
    (by default ``NOISE`` of the feature's deviation or mean size, the larger one) and with
    ``noise_bits`` steps; what stays equal is at distance 0, and is near if it is equal. Rows
    lacking the feature or the class are left out, and so are classes of one row. A feature
    without such rows has no score.
    """
    features = list(features or feature_columns(df, label, exclude=[key]))
    if block_rows < neighbours:
        raise ValueError("a block must hold at least the neighbours")
    points = _points(df, key, label, features, seed, noise, noise_bits)
    sizes = points.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = F.broadcast(sizes) if len(features) * df.select(label).distinct().count() <= MAX_CLASSES else sizes
    # Both steps read their rows several times: to count groups, to draw split points, to number.
    points = materialize(points.join(sizes, ["feature", "label"]), "points")
    distances = materialize(_distances(points, neighbours, hot_rows, block_rows), "distances")
    near = _near_counts(distances, hot_rows)
    mean = near.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(digamma(F.col("k")) - digamma(F.col("n")) - digamma(F.col("near"))).alias("mean")
    )
    return mean.select("feature", F.greatest(digamma(F.col("rows")) + F.col("mean"), F.lit(0.0)).alias("mi"))


def _points(df: DataFrame, key: str, label: str, features: Sequence[str], seed: int, noise: float | None, bits: int) -> DataFrame:
    """(feature, label, id, x) of all present values, with their noise."""
    values = {c: missing_as_null(c) for c in features}
    if noise is None:
        spread = [F.greatest(F.stddev_pop(v), F.avg(F.abs(v))) for v in values.values()]
        widths = [NOISE * (w or 1.0) for w in df.agg(*[s.alias(f"w{i}") for i, s in enumerate(spread)]).first()]
    else:
        widths = [noise] * len(features)
    steps = F.floor(digest_number(key_digest(key, seed)) / 2 ** (32 - bits)) / float(2**bits)
    noisy = [F.struct(F.lit(c).alias("feature"), (v + steps * width).alias("x")) for (c, v), width in zip(values.items(), widths)]
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("id"), F.inline(F.array(*noisy)))
    return rows.where("x IS NOT NULL")


def _distances(points: DataFrame, neighbours: int, hot_rows: int, block_rows: int) -> DataFrame:
    """(feature, id, x, n, k, d): the distance to the k-th nearest of the class; k is fewer in small classes."""
    numbered = number_rows(points, ["feature", "label"], ["x", "id"], "at", hot_rows)
    block, place = F.expr(f"at div {block_rows}"), F.col("at") % block_rows
    slots = F.array(
        F.struct(block.alias("block"), F.lit(False).alias("halo")),
        F.when(place < neighbours, F.struct((block - 1).alias("block"), F.lit(True).alias("halo"))),
        F.when(place >= block_rows - neighbours, F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))),
    )
    slotted = numbered.select("*", F.inline(F.filter(slots, lambda s: s.isNotNull())))
    ordered = W.partitionBy("feature", "label", "block").orderBy("at")
    before = [F.col("x") - F.lag("x", i).over(ordered) for i in range(1, neighbours + 1)]
    after = [F.lead("x", i).over(ordered) - F.col("x") for i in range(1, neighbours + 1)]
    k = F.least(F.lit(neighbours), F.col("n") - 1).cast("int")
    # Absent neighbours are null and come last.
    found = slotted.select("feature", "id", "x", "n", "halo", k.alias("k"), F.array_sort(F.array(*before, *after)).alias("distances"))
    return found.where(~F.col("halo")).select("feature", "id", "x", "n", "k", F.get("distances", F.col("k") - 1).alias("d"))


def _near_counts(distances: DataFrame, hot_rows: int) -> DataFrame:
    """(feature, id, n, k, near): how many rows are nearer than d, or at the same place if d is 0."""
    x, d = F.col("x"), F.col("d")

    def end(at: Column, order: Column, is_value: bool, of: str) -> Column:
        return F.struct(at.alias("v"), order.alias("turn"), F.lit(int(is_value)).alias("is_value"), F.lit(of).alias("of"))

    # At one place, ends with turn 0 come before the values (turn 1), those with turn 2 after them.
    apart = d > 0
    low = end(x - d, F.when(apart, 2).otherwise(0), False, "low")
    high = end(x + d, F.when(apart, 0).otherwise(2), False, "high")
    ends = distances.select("feature", "id", "n", "k", F.inline(F.array(end(x, F.lit(1), True, "value"), low, high)))
    counted = running_sum(ends, ["feature"], ["v", "turn"], "is_value", "values", hot_rows).where("of != 'value'")
    signed = F.when(F.col("of") == "high", F.col("values")).otherwise(-F.col("values"))
    return counted.groupBy("feature", "id", "n", "k").agg(F.sum(signed).alias("near"))
