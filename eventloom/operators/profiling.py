"""Tables that describe the encoded events. Each reads the data once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.events import missing_as_null
from eventloom.functions.stats import correlation, n_log_n
from eventloom.operators.cleaning import feature_columns
from eventloom.operators.encoding import fit_min_max
from eventloom.schemas import LABEL, NUM_CLASSES

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_NUMERIC = (*_WHOLE, "float", "double")
# Columns whose patterns of present ones are few enough to group by.
PASS_COLUMNS = 16
# Rows whose products are taken at once.
MOMENT_ROWS = 8192
_MOMENTS = ["i", "j", "n", "x", "y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y"]


def class_histogram(df: DataFrame, label: str = LABEL, classes: int = NUM_CLASSES) -> DataFrame:
    """Rows per class 0..classes-1, empty classes as 0; other values are not counted."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every_class = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return every_class.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, dtype in df.dtypes if dtype in _NUMERIC or dtype.startswith("decimal")]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation (a, b, r) of all ordered pairs, over rows where both are present.

    A column that is constant over those rows has no correlation (null), not even with itself;
    NaN is a missing value. A first pass takes the means, which are taken off for precision.
    Up to ``PASS_COLUMNS`` columns, sums and products are added up per pattern of present columns;
    the rows of a pair are those of the patterns that have both. More columns have too many
    patterns: tasks then add up matrices of all pairs, still in one pass.
    """
    columns = list(columns or numeric_columns(df))
    values = df.select(*[missing_as_null(c).alias(f"v{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(v).alias(v) for v in values.columns]).first()
    centred = values.select(*[(F.col(v) - F.lit(means[v] or 0.0)).alias(v) for v in values.columns])
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    one_way = _correlations(centred, columns, pairs) if len(columns) <= PASS_COLUMNS else _moment_correlations(centred, columns)
    this, other = F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return one_way.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(this)).otherwise(F.array(this, other))))


def _moment_correlations(centred: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs a <= b from masked moments.

    With the values, 0 where missing, as a matrix X and their presence as a matrix M, the rows, sums, squares and
    products of all pairs are M'M, X'M, (X^2)'M and X'X. A task adds them up over its rows and
    gives one row per pair; these are added in turn.
    """
    d = len(columns)
    i, j = np.triu_indices(d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, d, d))
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, MOMENT_ROWS):
                part = batch.slice(at, MOMENT_ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                present = ~np.isnan(x)
                m, zeroed = present.astype(float), np.where(present, x, 0.0)
                squares = zeroed**2
                sums += np.stack([m.T @ m, zeroed.T @ m, m.T @ zeroed, squares.T @ m, m.T @ squares, zeroed.T @ zeroed])
                for k in range(d):  # the bounds of every column over the rows that have column k
                    mine = x[present[:, k]]
                    if len(mine):
                        low[:, k] = np.fmin(low[:, k], np.fmin.reduce(mine, axis=0))
                        high[:, k] = np.fmax(high[:, k], np.fmax.reduce(mine, axis=0))
        sides = [low[i, j], high[i, j], low[j, i], high[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), *(s[i, j] for s in sums), *sides)], names=_MOMENTS)

    parts = centred.mapInArrow(moments, ", ".join(f"{n} {'int' if n in 'ij' else 'double'}" for n in _MOMENTS))
    names = F.lit(list(columns))
    varies = (F.min("low_x") < F.max("high_x")) & (F.min("low_y") < F.max("high_y"))
    r = correlation(F.nullif(F.sum("n"), F.lit(0.0)), *[F.sum(c) for c in ("x", "y", "xx", "yy", "xy")])
    total = parts.groupBy("i", "j").agg(F.when(varies, r).alias("r"))
    return total.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "r")


def _correlations(centred: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    members = sorted({i for pair in pairs for i in pair})
    place = {i: at for at, i in enumerate(members)}
    products = {pair: k for k, pair in enumerate(dict.fromkeys([*pairs, *((i, i) for i in members)]))}
    values = [f"v{i}" for i in members]
    present = sum((F.when(F.col(v).isNull(), 0).otherwise(1 << at) for at, v in enumerate(values)), F.lit(0))
    sums = (
        centred.select(present.cast("bigint").alias("present"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
        .groupBy("present")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(v) for v in values]).alias("x"),
            F.array(*[F.min(v) for v in values]).alias("low"),
            F.array(*[F.max(v) for v in values]).alias("high"),
            F.array(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in products]).alias("xx"),
        )
    )
    cells = [
        {"a": columns[i], "b": columns[j], "i": place[i], "j": place[j], "bits": 1 << place[i] | 1 << place[j],
         "ij": products[i, j], "ii": products[i, i], "jj": products[j, j]}
        for i, j in pairs
    ]
    cell_type = "array<struct<a: string, b: string, i: int, j: int, bits: bigint, ij: int, ii: int, jj: int>>"
    of_pairs = sums.select("*", F.inline(F.from_json(F.lit(json.dumps(cells)), cell_type)))
    both = F.col("present").bitwiseAND(F.col("bits")) == F.col("bits")

    def over(aggregate: Callable[[Column], Column], array: str, at: str) -> Column:
        return aggregate(F.when(both, F.get(array, F.col(at))))

    def varies(at: str) -> Column:
        return over(F.min, "low", at) < over(F.max, "high", at)

    r = correlation(
        F.sum(F.when(both, F.col("n"))),
        *[over(F.sum, "x", at) for at in ("i", "j")],
        *[over(F.sum, "xx", at) for at in ("ii", "jj", "ij")],
    )
    return of_pairs.groupBy("a", "b").agg(F.when(varies("i") & varies("j"), r).alias("r"))


def feature_scores(
    df: DataFrame,
    label: str = LABEL,
    features: Sequence[str] | None = None,
    bins: int | None = None,
    binned: Sequence[str] = (),
) -> DataFrame:
    """Mutual information (nats) of each feature with the label: (feature, mi).

    MI = H(feature) + H(label) - H(feature, label) over the observed values; features in
    ``binned`` are first cut into ``bins`` equal-width bins. Rows lacking either side are
    left out. The scan shrinks to (feature, value, label) counts before anything is
    shuffled, so neither a frequent value nor a frequent class makes a large group.
    """
    features = list(features or feature_columns(df, label))
    if binned:
        df = equal_width_bins(df, binned, bins or 10)
    # One column has to hold the values of all features; whole numbers are the cheapest to hash.
    dtypes = {dtype for c, dtype in df.dtypes if c in features}
    common = "bigint" if dtypes <= set(_WHOLE) else "double" if dtypes <= set(_NUMERIC) else "string"
    cells = (
        df.select(label, *[F.col(f).cast(common).alias(f) for f in features])
        .unpivot([label], features, "feature", "value")
        .where(F.col("value").isNotNull() & F.col(label).isNotNull())
        .groupBy("feature", "value", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sets = cells.groupingSets(
        [("feature", "value", label), ("feature", "value"), ("feature", label)], "feature", "value", label
    ).agg(F.sum("n").alias("n"), F.grouping("value").alias("no_value"), F.grouping(label).alias("no_label"))
    terms = sets.groupBy("feature").agg(
        _entropy_sum((F.col("no_value") == 0) & (F.col("no_label") == 0)).alias("joint"),
        _entropy_sum(F.col("no_label") == 1).alias("by_value"),
        _entropy_sum(F.col("no_value") == 1).alias("by_label"),
        F.sum(F.when(F.col("no_value") == 1, F.col("n"))).cast("double").alias("total"),
    )
    mi = (F.col("joint") - F.col("by_value") - F.col("by_label")) / F.col("total") + F.log("total")
    return terms.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


def _entropy_sum(which: Column) -> Column:
    return F.sum(F.when(which, n_log_n(F.col("n"))))


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Replace each column by its bin 0..bins-1 between its minimum and maximum."""
    scaled = fit_min_max(df, columns).transform(df)
    last = F.lit(bins - 1)
    return scaled.withColumns({c: F.least(F.floor(F.col(c) * bins).cast("int"), last) for c in columns})


def top_k_features(scores: DataFrame, k: int | str = "all") -> DataFrame:
    """Features by descending score, the ``k`` best or all of them; there is one row per feature."""
    ranked = scores.orderBy(F.desc("mi"), "feature")
    return ranked if k == "all" else ranked.limit(k)


def distinct_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.select(F.col(label).alias("label")).distinct()
