"""From raw events to the encoded table, and from encoded columns to model input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import (
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorIndexer,
    VectorIndexerModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.events import (
    degree_bucket,
    event_class,
    lenient_number,
    missing_as_null,
    month_of,
    recode_event_code,
    root_code,
    strict_int,
    year_of,
)
from eventloom.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, lookup, measure
from eventloom.operators.ordering import HOT_ROWS, GroupLoad, number_rows
from eventloom.schemas import ACTORS, CODE_CLASSES, GEO_DEGREES, GEO_LATITUDES, GEO_TYPES, LABEL, NUM_CLASSES
from eventloom.session import materialize


def encode_fields(events: DataFrame) -> DataFrame:
    """All row-wise encodings; the actors keep their names. Works on streams as well."""
    columns = {
        LABEL: event_class(LABEL),
        "QuadClass": lenient_number("QuadClass", "int"),
        "Goldstein": lenient_number("Goldstein"),
        **{c: strict_int(c) for c in GEO_TYPES},
        **{c: missing_as_null(c) for c in GEO_DEGREES},
        **{f"{c}Int": degree_bucket(c) for c in GEO_LATITUDES},
        "Month": month_of("Date"),
        "Year": year_of("Date"),
    }
    return events.withColumns(columns)


def code_collisions(events: DataFrame, code: str = LABEL) -> DataFrame:
    """Rows per (class, code) that reach a class reserved for a recoded value without being it.

    Empty where the reserved classes mean only what they were reserved for.
    """
    reserved = list(CODE_CLASSES.values())
    return (
        events.where(root_code(recode_event_code(code)).isin(reserved) & ~F.col(code).isin(list(CODE_CLASSES)))
        .groupBy(event_class(code).alias("event_class"), F.col(code).alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- dictionaries -----------------------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    """Numbers 0..n-1 of one column's sorted values, null last. ``table`` is (value, code)."""

    column: str
    table: DataFrame
    broadcast: bool

    def apply(self, df: DataFrame, output: str | None = None) -> DataFrame:
        """Replace the column by its code, or add the code as ``output``; unseen values get null."""
        target = output or self.column
        coded = lookup(df, self.table.withColumnRenamed("code", "__code"), self.column, "value", self.broadcast)
        return coded.withColumn(target, F.col("__code")).drop("__code")


def fit_dictionaries(
    df: DataFrame, columns: Sequence[str] = ACTORS, hot_rows: int = HOT_ROWS
) -> list[Dictionary]:
    """One dictionary per column for the whole table, whatever its partitioning.

    One pass finds the distinct values of all columns, which must share a type. They are
    stored once; they, not the events, are sorted and numbered.
    """
    values = materialize(df.unpivot([], list(columns), "column", "value").distinct(), "values")
    sizes = {r["column"]: r for r in values.groupBy("column").agg(*measure(values)).collect()}
    rows = [size["n"] for size in sizes.values()]
    ordered = values.withColumn("missing", F.col("value").isNull())
    numbered = number_rows(
        ordered, ["column"], ["missing", "value"], "code", hot_rows, GroupLoad(sum(rows), max(rows, default=0))
    )
    table = materialize(
        numbered.select("column", "value", F.col("code").cast("int").alias("code")), "dictionary"
    )
    fitted = []
    for c in columns:
        small = c not in sizes or (
            sizes[c]["n"] <= BROADCAST_ROWS and sizes[c]["bytes"] <= BROADCAST_BYTES
        )
        fitted.append(Dictionary(c, table.where(F.col("column") == c).drop("column"), small))
    return fitted


def fit_dictionary(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> Dictionary:
    return fit_dictionaries(df, [column], hot_rows)[0]


def save_dictionary(dictionary: Dictionary, path: str) -> None:
    dictionary.table.write.parquet(path)


def load_dictionary(spark: SparkSession, column: str, path: str) -> Dictionary:
    table = spark.read.parquet(path)
    return Dictionary(column, table, fits_broadcast(table))


def dictionary_encode(df: DataFrame, columns: Sequence[str] = ACTORS) -> DataFrame:
    """Fit and apply a dictionary per column."""
    return apply_dictionaries(df, fit_dictionaries(df, columns))


def apply_dictionaries(df: DataFrame, dictionaries: Sequence[Dictionary]) -> DataFrame:
    columns = df.columns
    for dictionary in dictionaries:
        df = dictionary.apply(df)
    return df.select(*columns)


def encode_events(events: DataFrame, dictionaries: Sequence[Dictionary] | None = None) -> DataFrame:
    """The encoded table: row-wise encodings plus actor numbers."""
    if dictionaries is None:
        dictionaries = fit_dictionaries(events)
    return apply_dictionaries(encode_fields(events), dictionaries)


# --- label and features -----------------------------------------------------------------


def fit_label_index(df: DataFrame, label: str = LABEL, output: str = "label") -> StringIndexerModel:
    """Label numbers by descending frequency over the whole table, ties alphabetical.

    The classes are held on the driver; there are ``NUM_CLASSES`` of them.
    """
    return StringIndexer(inputCol=label, outputCol=output).fit(df)


def label_index(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The fitted label numbers as a table (label, index)."""
    labels = fit_label_index(df, label).labels
    return df.sparkSession.createDataFrame(list(enumerate(labels)), "index int, label string")


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    """Feature vector of the named columns, in order; a null raises."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return assembler(features, output).transform(df)


def fit_category_index(
    df: DataFrame, features: str = "features", output: str = "indexed", max_categories: int = 4
) -> VectorIndexerModel:
    """Index features with at most ``max_categories`` distinct values as categories."""
    return VectorIndexer(
        inputCol=features, outputCol=output, maxCategories=max_categories, handleInvalid="error"
    ).fit(df)


def one_hot_label(
    df: DataFrame, label: str = LABEL, output: str = "label_vector", classes: int = NUM_CLASSES
) -> DataFrame:
    """One position per class 0..classes-1, present in the data or not."""
    every_class = df.sparkSession.range(classes).select(F.col("id").cast("double").alias(label))
    encoder = OneHotEncoder(inputCol=label, outputCol=output, dropLast=False).fit(every_class)
    return encoder.transform(df)


# --- scaling ----------------------------------------------------------------------------


@dataclass(frozen=True)
class MinMaxScale:
    """Fitted column bounds; a constant column scales to 0."""

    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._scaled(c) for c in self.bounds})

    def _scaled(self, column: str):
        low, high = self.bounds[column]
        value = missing_as_null(column)
        if low is None or low == high:
            return F.when(value.isNotNull(), F.lit(0.0))
        return (value - F.lit(low)) / F.lit(high - low)


def column_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of the values present, one row per column, from one pass over the table."""
    stats = df.agg(
        *[F.min(missing_as_null(c)).alias(f"min_{i}") for i, c in enumerate(columns)],
        *[F.max(missing_as_null(c)).alias(f"max_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"min_{i}").alias("low"), F.col(f"max_{i}").alias("high"))
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.inline(rows))


def fit_min_max(df: DataFrame, columns: Sequence[str]) -> MinMaxScale:
    """Bounds of each column; fit on the training part to keep the test part unseen."""
    return MinMaxScale({r["feature"]: (r["low"], r["high"]) for r in column_bounds(df, columns).collect()})


def min_max_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame) -> DataFrame:
    """Scale columns to [0, 1] by the bounds of ``fit_on``: the training part, or the whole table."""
    return fit_min_max(fit_on, columns).transform(df)
