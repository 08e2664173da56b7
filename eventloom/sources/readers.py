"""Typed scans. No reader infers a schema: inference would scan the data twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.events import missing_as_null, missing_text_as_null
from eventloom.schemas import CODES, CORRUPT_COLUMN, ENCODED, EXTRA_COLUMN, RAW


# Where a fused record of the code lookup starts; the group is its code.
FUSED_CODE = r"([0-9]{2,4}):\[-?[0-9.]+\]"


def raw_schema(extra: bool = False, keep_corrupt: bool = False) -> T.StructType:
    fields = list(RAW.fields)
    if extra:
        fields.append(T.StructField(EXTRA_COLUMN, T.DoubleType()))
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT_COLUMN, T.StringType()))
    return T.StructType(fields)


def raw_options(keep_corrupt: bool = False, mode: str | None = None) -> dict[str, str]:
    """Options shared by the batch and the streaming scan of raw files."""
    options = {
        "sep": "\t",
        "header": "true",
        "quote": "",
        "mode": mode or ("PERMISSIVE" if keep_corrupt else "FAILFAST"),
    }
    if keep_corrupt:
        options["columnNameOfCorruptRecord"] = CORRUPT_COLUMN
    return options


def read_events(
    spark: SparkSession, path: str | list[str], extra: bool = False, keep_corrupt: bool = False
) -> DataFrame:
    """Scan tab-separated raw event files, typed by position.

    A malformed field ends the scan, as a typed load should. With ``keep_corrupt`` the row
    is kept instead, its bad fields null and its text in ``_corrupt_record``.
    ``extra`` reads files with an eighteenth, unnamed position. Fields that spell a missing
    value are null: any spelling in text, NaN in numbers.
    """
    return without_missing(
        spark.read.schema(raw_schema(extra, keep_corrupt))
        .options(**raw_options(keep_corrupt))
        .csv(path)
    )


def without_missing(events: DataFrame) -> DataFrame:
    """Raw rows as parsed, with missing values as null. Works on streams as well."""
    kinds = dict(events.dtypes)
    clean = {"string": missing_text_as_null, "double": missing_as_null}
    return events.select(
        *[clean[kinds[c]](c).alias(c) if kinds[c] in clean and c != CORRUPT_COLUMN else F.col(c) for c in events.columns]
    )


_FILE_ORDER_FIELDS = [
    T.StructField("SourceFile", T.StringType()),
    T.StructField("SplitStart", T.LongType()),
    T.StructField("SplitRow", T.LongType()),
]
FILE_ORDER = [f.name for f in _FILE_ORDER_FIELDS]


def with_file_order(events: DataFrame) -> DataFrame:
    """Add the columns ``FILE_ORDER``, whose order is that of the rows in their files.

    Raw rows have no identifier. Store the result before ordering by these columns: the row
    numbers are those of this scan.
    """
    low_bits = F.lit(2**33 - 1)
    return events.select(
        "*",
        F.col("_metadata.file_path").alias("SourceFile"),
        F.col("_metadata.file_block_start").alias("SplitStart"),
        F.monotonically_increasing_id().bitwiseAND(low_bits).alias("SplitRow"),
    )


def read_encoded(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, file_order: bool = False
) -> DataFrame:
    """Scan the encoded Parquet table; only the named columns are read."""
    schema = T.StructType([*ENCODED.fields, *_FILE_ORDER_FIELDS]) if file_order else ENCODED
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_encoded_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan an encoded table kept as CSV; columns are found by position in ``ENCODED``."""
    df = spark.read.schema(ENCODED).options(header="true", mode="FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Scan the event-code lookup. Codes are text: ``01`` and ``010`` differ.

    A line may hold further records, each a code, a colon and a number in brackets, right after
    the description before: they become rows of their own.
    """
    lines = spark.read.schema(CODES).options(sep="\t", header="true", quote="").csv(path)
    parts = F.split("description", FUSED_CODE)
    codes = F.concat(F.array("code"), F.regexp_extract_all("description", F.lit(FUSED_CODE), 1))
    split = lines.withColumn("record", F.explode(F.arrays_zip(codes.alias("code"), parts.alias("description"))))
    whole = lines.where(F.col("description").isNull())
    return split.select("record.code", F.trim("record.description").alias("description")).union(whole)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Scan a table of look-back windows; its columns depend on the actor and order columns."""
    return spark.read.parquet(path)
