"""Scalar encodings, row by row."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventloom.functions import events as E
from eventloom.operators import cleaning, encoding
from eventloom.schemas import RAW


def values(spark, expression, inputs, dtype="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


CODES = {
    "042": 20, "043": 21, "046": 22, "044": 51, "041": 52, "045": 53, "020": 54,
    "0420": 4, "02": 2, "0211": 2, "021": 2, "040": 4, "010": 1, "1056": 10, "200": 20,
    "---": 0, "X": 0, "": 0, "1d": 0, "5": 5, " 7": 7, None: 0,
}


def test_event_class(spark):
    assert values(spark, E.event_class, CODES) == list(CODES.values())


def test_recode_is_whole_value_and_does_not_cascade(spark):
    codes = ["042", "20", "0420", "020", "54", None]
    assert values(spark, E.recode_event_code, codes) == ["20", "20", "0420", "54", "54", None]


def test_lenient_number_keeps_null(spark):
    texts = ["3", "2.5", "-7.", "na", "", "1f", "1e2", None]
    assert values(spark, E.lenient_number, texts) == [3.0, 2.5, -7.0, None, None, None, 100.0, None]
    ints = values(spark, lambda x: E.lenient_number(x, "int"), ["3", "2.5", "x", None])
    assert ints == [3, 2, None, None]


def test_strict_int(spark):
    assert values(spark, E.strict_int, ["3", "4.0", None]) == [3, 4, 0]
    assert values(spark, E.strict_int, [3.0, None], "double") == [3, 0]
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        values(spark, E.strict_int, ["x"])


def test_degrees_truncate_toward_zero(spark):
    degrees = [-33.9, 33.9, -0.5, 0.0, None]
    assert values(spark, E.degree_bucket, degrees, "double") == [-33, 33, 0, 0, 0]


def test_date_parts(spark):
    assert values(spark, E.month_of, ["19790101", "20141231"]) == [1, 12]
    assert values(spark, E.year_of, ["19790101", "20141231"]) == [1979, 2014]


def test_predictions_round_half_to_even(spark):
    assert values(spark, E.round_prediction, [0.5, 1.5, 2.4, 2.6], "double") == [0.0, 2.0, 2.0, 3.0]


def raw_row(**fields):
    base = dict.fromkeys(RAW.names)
    base.update(Date="20010203", NumEvents=1, NumArts=200)
    base.update(fields)
    return tuple(base[n] for n in RAW.names)


def test_encode_fields_keeps_article_counts_wide(spark):
    row = encoding.encode_fields(spark.createDataFrame([raw_row(CAMEOCode="043", SourceGeoLat=-33.9)], RAW)).first()
    assert (row.CAMEOCode, row.NumArts, row.SourceGeoLatInt, row.SourceGeoType, row.Month, row.Year) == (
        21, 200, -33, 0, 2, 2001
    )
    assert row.QuadClass is None and row.Goldstein is None


def test_filters_and_projections(spark):
    rows = [raw_row(CAMEOCode=c, Source=s) for c, s in [("041", "A"), ("---", "A"), ("010", None), ("046", "B")]]
    df = encoding.encode_fields(spark.createDataFrame(rows, RAW))
    valid = cleaning.keep_valid_classes(df)
    assert sorted(r.CAMEOCode for r in valid.collect()) == [0, 1, 22]
    assert cleaning.filter_actor(valid, "A").count() == 1
    narrow = cleaning.drop_leaky(cleaning.drop_leaky(valid))
    assert "Goldstein" not in narrow.columns and "QuadClass" not in narrow.columns
    assert cleaning.feature_columns(narrow, exclude=["Date"])[0] == "Source"


def test_collisions_name_the_codes_that_share_a_reserved_class(spark):
    rows = [raw_row(CAMEOCode=c) for c in ["200", "204", "042", "20", "010", "520", None]]
    found = encoding.code_collisions(spark.createDataFrame(rows, RAW))
    assert sorted((r.event_class, r.code, r.n) for r in found.collect()) == [
        (20, "20", 1), (20, "200", 1), (20, "204", 1), (52, "520", 1)
    ]
