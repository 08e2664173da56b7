"""Column names, types and fixed values of the event data model."""

from __future__ import annotations

from pyspark.sql import types as T

LABEL = "CAMEOCode"
ACTORS = ["Source", "Target"]
GEO_TYPES = ["SourceGeoType", "TargetGeoType", "ActionGeoType"]
GEO_LATITUDES = ["SourceGeoLat", "TargetGeoLat", "ActionGeoLat"]
GEO_DEGREES = [f"{place}Geo{kind}" for place in ("Source", "Target", "Action") for kind in ("Lat", "Long")]
LEAKY = ["QuadClass", "Goldstein"]

# The raw file is typed by position. Everything that is parsed
# tolerantly or strictly later on (class, quad class, tone, source geo type) stays text.
RAW = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Source", T.StringType()),
        T.StructField("Target", T.StringType()),
        T.StructField("CAMEOCode", T.StringType()),
        T.StructField("NumEvents", T.IntegerType()),
        T.StructField("NumArts", T.IntegerType()),
        T.StructField("QuadClass", T.StringType()),
        T.StructField("Goldstein", T.StringType()),
        T.StructField("SourceGeoType", T.StringType()),
        T.StructField("SourceGeoLat", T.DoubleType()),
        T.StructField("SourceGeoLong", T.DoubleType()),
        T.StructField("TargetGeoType", T.DoubleType()),
        T.StructField("TargetGeoLat", T.DoubleType()),
        T.StructField("TargetGeoLong", T.DoubleType()),
        T.StructField("ActionGeoType", T.DoubleType()),
        T.StructField("ActionGeoLat", T.DoubleType()),
        T.StructField("ActionGeoLong", T.DoubleType()),
    ]
)

# Texts that stand for a missing value in raw files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Name for the unnamed eighteenth position some raw files carry.
EXTRA_COLUMN = "Extra"
CORRUPT_COLUMN = "_corrupt_record"

# The encoded table keeps the raw columns, retyped, and appends five derived ones.
ENCODED = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Source", T.IntegerType()),
        T.StructField("Target", T.IntegerType()),
        T.StructField("CAMEOCode", T.IntegerType()),
        T.StructField("NumEvents", T.IntegerType()),
        T.StructField("NumArts", T.IntegerType()),
        T.StructField("QuadClass", T.IntegerType()),
        T.StructField("Goldstein", T.DoubleType()),
        T.StructField("SourceGeoType", T.IntegerType()),
        T.StructField("SourceGeoLat", T.DoubleType()),
        T.StructField("SourceGeoLong", T.DoubleType()),
        T.StructField("TargetGeoType", T.IntegerType()),
        T.StructField("TargetGeoLat", T.DoubleType()),
        T.StructField("TargetGeoLong", T.DoubleType()),
        T.StructField("ActionGeoType", T.IntegerType()),
        T.StructField("ActionGeoLat", T.DoubleType()),
        T.StructField("ActionGeoLong", T.DoubleType()),
        T.StructField("SourceGeoLatInt", T.IntegerType()),
        T.StructField("TargetGeoLatInt", T.IntegerType()),
        T.StructField("ActionGeoLatInt", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Year", T.IntegerType()),
    ]
)

CODES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# The twelve modelling columns, label included.
MODEL_COLUMNS = [
    "Source", "Target", "CAMEOCode", "NumEvents", "NumArts", "SourceGeoType",
    "TargetGeoType", "ActionGeoType", "SourceGeoLatInt", "TargetGeoLatInt", "ActionGeoLatInt", "Month",
]
FEATURES = [c for c in MODEL_COLUMNS if c != LABEL]

# Codes that get a class of their own (20-22), and codes too rare to
# model (51-54), which keep_valid_classes removes.
CODE_CLASSES = {
    "042": "20",
    "043": "21",
    "046": "22",
    "044": "51",
    "041": "52",
    "045": "53",
    "020": "54",
}
MAX_CLASS = 22
NUM_CLASSES = MAX_CLASS + 1

LOOK_BACK = 30
