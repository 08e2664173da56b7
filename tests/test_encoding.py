"""Dictionaries, lookups, label index, scaling."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from eventloom.operators import encoding, lookup
from eventloom.session import materialize


@pytest.fixture(scope="module")
def actors(spark):
    rng = random.Random(3)
    names = [None] + [f"N{i}" for i in range(300)]
    rows = [(i, "USA" if i % 3 == 0 else rng.choice(names), rng.choice(names[:9])) for i in range(3000)]
    return spark.createDataFrame(rows, "rid int, Source string, Target string")


def expected_codes(rows, column):
    present = sorted({r[column] for r in rows if r[column] is not None})
    codes = {v: i for i, v in enumerate(present)}
    codes[None] = len(present)
    return codes


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_dictionaries_are_sorted_with_null_last(actors, hot_rows):
    rows = actors.collect()
    for dictionary in encoding.fit_dictionaries(actors, ["Source", "Target"], hot_rows):
        found = {r["value"]: r["code"] for r in dictionary.table.collect()}
        assert found == expected_codes(rows, dictionary.column)


def test_encoding_does_not_depend_on_partitions(actors):
    one = encoding.dictionary_encode(actors.repartition(1))
    many = encoding.dictionary_encode(actors.repartition(13, "Target"))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    codes = expected_codes(actors.collect(), "Source")
    joined = one.join(actors.select("rid", F.col("Source").alias("name")), "rid").collect()
    assert all(r["Source"] == codes[r["name"]] for r in joined)


def test_unseen_value_gets_null_and_dictionary_reloads(spark, actors, tmp_path):
    fitted = encoding.fit_dictionary(actors, "Source")
    encoding.save_dictionary(fitted, str(tmp_path / "d"))
    again = encoding.load_dictionary(spark, "Source", str(tmp_path / "d"))
    new = spark.createDataFrame([("nobody",), ("USA",), (None,)], "Source string")
    codes = expected_codes(actors.collect(), "Source")
    found = sorted((r[0] is None, r[0]) for r in again.apply(new).collect())
    assert found == [(False, codes["USA"]), (False, codes[None]), (True, None)]


@pytest.mark.parametrize("broadcast,hot_rows", [(True, 1), (False, 10**6), (False, 100), (False, 9)])
def test_lookup_keeps_every_row_once(spark, actors, broadcast, hot_rows):
    dim = spark.createDataFrame([("USA", "u"), ("N1", "n"), (None, "none")], "value string, note string")
    found = lookup.lookup(actors, dim, "Source", "value", broadcast, hot_rows)
    assert found.columns == ["rid", "Source", "Target", "note"]
    notes = {"USA": "u", "N1": "n", None: "none"}
    rows = found.collect()
    assert sorted(r["rid"] for r in rows) == list(range(3000))
    assert all(r["note"] == notes.get(r["Source"]) for r in rows)


def test_lookup_of_equal_rows(spark, actors):
    same = actors.select("Source")
    dim = materialize(encoding.fit_dictionary(same, "Source").table)
    found = lookup.lookup(same, dim, "Source", "value", broadcast=False, hot_rows=500)
    expected = dict(same.groupBy("Source").count().collect())
    assert dict(found.groupBy("Source").count().collect()) == expected
    assert found.where("code is null").isEmpty()


def test_large_tables_are_not_broadcast(spark):
    dim = spark.range(1000).select(F.col("id").cast("string").alias("value"))
    assert lookup.fits_broadcast(dim)
    assert not lookup.fits_broadcast(dim, max_rows=999)
    assert not lookup.fits_broadcast(dim, max_bytes=1000)


def test_describe_codes(spark):
    codes = spark.createDataFrame([("04", "CONSULT"), ("042", "Make a visit"), ("01", "SAY")], "code string, description string")
    events = spark.createDataFrame([("042",), ("04",), ("0431",), ("X",), (None,)], "CAMEOCode string")
    found = {r[0]: (r[1], r[2]) for r in lookup.describe_codes(events, codes).collect()}
    assert found == {
        "042": ("Make a visit", "CONSULT"), "04": ("CONSULT", "CONSULT"), "0431": (None, "CONSULT"),
        "X": (None, None), None: (None, None),
    }


def test_label_index_orders_by_frequency_then_name(spark):
    df = spark.createDataFrame([(x,) for x in "bbcaad"], "CAMEOCode string")
    assert [(r["index"], r["label"]) for r in encoding.label_index(df).orderBy("index").collect()] == [
        (0, "a"), (1, "b"), (2, "c"), (3, "d")
    ]


def test_one_hot_has_a_place_for_absent_classes(spark):
    df = spark.createDataFrame([(0.0,), (22.0,)], "CAMEOCode double")
    vectors = encoding.one_hot_label(df).orderBy("CAMEOCode").select(vector_to_array("label_vector")).collect()
    assert [len(v[0]) for v in vectors] == [23, 23]
    assert [v[0].index(1.0) for v in vectors] == [0, 22]


def test_scaling_by_training_bounds(spark):
    df = spark.createDataFrame([(1, 5.0, 7), (3, 10.0, 7), (5, None, 7)], "a int, b double, c int")
    rows = [tuple(r) for r in encoding.min_max_scale(df, ["a", "b", "c"], fit_on=df).orderBy("a").collect()]
    assert rows == [(0.0, 0.0, 0.0), (0.5, 1.0, 0.0), (1.0, None, 0.0)]
    train = df.where("a < 5")
    beyond = encoding.min_max_scale(df, ["a"], fit_on=train).agg(F.max("a")).first()[0]
    assert beyond == 2.0


def test_assembling_a_null_raises(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    with pytest.raises(Exception, match="(?i)null"):
        encoding.assemble(df, ["a", "b"]).collect()


def test_missing_numbers_do_not_spoil_a_column(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.0), (2, nan), (3, 10.0), (4, None), (5, 5.0)], "i int, x double")
    rows = {r["i"]: r["x"] for r in encoding.min_max_scale(df, ["x"], fit_on=df).collect()}
    assert rows == {1: 0.0, 2: None, 3: 1.0, 4: None, 5: 0.5}
    assert encoding.column_bounds(df, ["x"]).first()[1:] == (0.0, 10.0)
