"""Readers, writers and the raw-to-encoded jobs."""

import pytest
from pyspark.sql import functions as F

from checks.standin import raw_events
from eventloom.operators import encoding
from eventloom.operators.windows import lag_windows
from eventloom.plans.encoded_table import build_encoded_table, load_model_table
from eventloom.plans.sequences import store_sequences
from eventloom.schemas import ENCODED, MODEL_COLUMNS, RAW
from eventloom.session import materialize, scratch_path, scratch_tables, shared_dir
from eventloom.sources import readers, writers
from eventloom.streaming import ingest
from eventloom.streaming.ingest import ingest_chunks, read_chunks


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def events(spark, sf):
    return materialize(raw_events(spark, sf).select(*RAW.names), "raw-table")


@pytest.fixture(scope="module")
def raw_path(spark, events):
    path = scratch_path(spark, "raw-files")
    events.repartition(3).write.csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")
    return path


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_raw_files_round_trip(spark, events, raw_path):
    found = readers.read_events(spark, raw_path)
    assert found.dtypes == [(f.name, f.dataType.simpleString()) for f in RAW] and same(found, readers.without_missing(events))


def write(path, *lines):
    path.write_text("\n".join(["\t".join(RAW.names), *lines]) + "\n")
    return str(path)


GOOD = "19790101\tUSA\t\t042\t3\t200\t1\t1.9\t\t-33.9\t151\t1\t\t\t4\t1.5\t2"


def test_malformed_rows_end_the_scan_or_are_kept(spark, tmp_path):
    path = write(tmp_path / "raw.tsv", GOOD, GOOD.replace("\t3\t", "\tmany\t"))
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_events(spark, path).collect()
    rows = readers.read_events(spark, path, keep_corrupt=True).collect()
    assert [r["_corrupt_record"] is None for r in rows] == [True, False]
    assert (rows[0]["Target"], rows[0]["NumArts"], rows[0]["CAMEOCode"]) == (None, 200, "042")


def test_empty_fields_keep_their_place_and_an_extra_position_is_read(spark, tmp_path):
    path = write(tmp_path / "raw.tsv", GOOD + "\t9.5")
    row = readers.read_events(spark, path, extra=True).first()
    assert (row["SourceGeoType"], row["SourceGeoLat"], row["ActionGeoType"], row["Extra"]) == (None, -33.9, 4.0, 9.5)


def test_code_lookup_survives_its_defects(spark, tmp_path):
    lines = [
        "CAMEOEVENTCODE\tEVENTDESCRIPTION", "01\tMAKE STATEMENT", "010\tMake statement", '044\tMeet at a "third location',
        "105\tDemand one106:[-5.0] Demand another", "107\t", "108\tone109:[2] two1010:[-10.0] three",
    ]
    (tmp_path / "codes.tsv").write_text("\n".join(lines) + "\n")
    found = dict(map(tuple, readers.read_codes(spark, str(tmp_path / "codes.tsv")).collect()))
    assert found["044"].startswith('Meet at a "') and found.pop("107") is None
    assert sorted(found) == ["01", "010", "044", "1010", "105", "106", "108", "109"]
    assert (found["105"], found["106"], found["109"], found["1010"]) == ("Demand one", "Demand another", "two", "three")


def test_missing_values_of_raw_files_are_null(spark, tmp_path):
    line = GOOD.replace("\tUSA\t\t", "\tnull\tNA\t").replace("-33.9", "NaN").replace("\t1.9\t", "\tnan\t").replace("\t4\t", "\tNaN\t")
    row = readers.read_events(spark, write(tmp_path / "raw.tsv", line, GOOD)).where("Source is null").first()
    assert [row[c] for c in ("Source", "Target", "Goldstein", "SourceGeoLat", "ActionGeoType")] == [None] * 5
    encoded = encoding.encode_events(readers.read_events(spark, str(tmp_path / "raw.tsv"))).where("Goldstein is null").first()
    assert (encoded["SourceGeoLatInt"], encoded["ActionGeoType"], encoded["SourceGeoLat"]) == (0, 0, None)


def test_scratch_tables_go(spark):
    with scratch_tables(spark):
        table = materialize(spark.range(3))
        path = table.inputFiles()[0]
        assert table.count() == 3
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        spark.read.parquet(path)
    kept = materialize(spark.range(2))
    assert kept.count() == 2


@pytest.fixture(scope="module")
def encoded_path(spark, raw_path):
    path = scratch_path(spark, "encoded-table")
    build_encoded_table(spark, raw_path, path, file_order=True)
    return path


def test_encoded_table(spark, events, encoded_path):
    found = readers.read_encoded(spark, encoded_path)
    assert set(found.columns) == set(ENCODED.names)
    assert same(found.select(*ENCODED.names), encoding.encode_events(events).select(*ENCODED.names))
    model = load_model_table(spark, encoded_path)
    assert model.columns == MODEL_COLUMNS and model.agg(F.max("CAMEOCode")).first()[0] <= 22


def test_model_table_scan_is_pruned_and_filtered(spark, encoded_path):
    plan = load_model_table(spark, encoded_path)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(CAMEOCode,22)" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "Goldstein" not in schema and "GeoLong" not in schema
    months = readers.read_encoded(spark, encoded_path).where("Year = 1997 and Month = 3")
    assert "PartitionFilters: [isnotnull(Year" in months._jdf.queryExecution().executedPlan().toString()


def test_file_order_is_that_of_the_lines(spark, tmp_path):
    lines = [GOOD.replace("\t3\t", f"\t{i}\t") for i in range(1000)]
    events = readers.read_events(spark, write(tmp_path / "raw.tsv", *lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        stored = materialize(readers.with_file_order(events).select("NumEvents", *readers.FILE_ORDER))
        assert events.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in stored.orderBy(*readers.FILE_ORDER).collect()] == list(range(1000))


def test_stored_sequences(spark, encoded_path):
    encoded = readers.read_encoded(spark, encoded_path, file_order=True)
    actor = encoded.groupBy("Source").count().orderBy(F.desc("count")).first()["Source"]
    stored = store_sequences(encoded, scratch_path(spark, "windows"), readers.FILE_ORDER, actor)
    valid = encoded.where(f"Source = {actor} and CAMEOCode <= 22")
    assert stored.count() == valid.count() - 30
    direct = lag_windows(valid, ["Source"], readers.FILE_ORDER, MODEL_COLUMNS, hot_rows=50, block_rows=60)
    assert same(stored, direct)


@pytest.mark.parametrize("files", [1, 2])
def test_chunks_do_not_change_the_table(spark, events, raw_path, files):
    out, progress = scratch_path(spark, "chunks"), scratch_path(spark, "progress")
    dictionaries = encoding.fit_dictionaries(events)

    def run():
        ingest_chunks(spark, raw_path, out, progress, dictionaries, files).awaitTermination()
        return readers.read_encoded(spark, out).select(*ENCODED.names)

    expected = encoding.encode_events(events, dictionaries).select(*ENCODED.names)
    assert same(run(), expected)
    # A second run finds nothing new.
    assert run().count() == expected.count()


def test_new_actors_get_codes_and_months_few_files(spark, tmp_path):
    one = GOOD.replace("\tUSA\t\t", "\tUSA\tFRA\t")
    (tmp_path / "raw").mkdir()
    write(tmp_path / "raw" / "1.tsv", one, GOOD)
    dictionaries = encoding.fit_dictionaries(readers.read_events(spark, str(tmp_path / "raw")))
    paths = [str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "progress")]
    ingest_chunks(spark, *paths, dictionaries, 1).awaitTermination()
    write(tmp_path / "raw" / "2.tsv", *[one.replace("FRA", x).replace("\tUSA", "\tCHN") for x in ("ZZZ", "AAA", "FRA", "") * 50])
    ingest_chunks(spark, *paths, dictionaries, 1).awaitTermination()
    write(tmp_path / "raw" / "3.tsv", one.replace("FRA", "AAA"))
    ingest_chunks(spark, *paths, dictionaries, 1).awaitTermination()
    found = read_chunks(spark, paths[1])
    counts = {tuple(r) for r in found.groupBy("Source", "Target").count().collect()}
    # FRA 0, missing 1, then AAA 2, ZZZ 3; USA 0, then CHN 1.
    assert counts == {(0, 0, 1), (0, 1, 1), (1, 0, 50), (1, 1, 50), (1, 2, 50), (1, 3, 50), (0, 2, 1)}
    assert len(spark.read.parquet(f"{paths[1]}/chunk=1").inputFiles()) == 1


def test_csv_sinks(spark, events, tmp_path):
    numbered = events.withColumn("rid", F.monotonically_increasing_id())
    writers.write_sample(numbered, str(tmp_path / "sample"), ["Date", "rid"], 50)
    assert spark.read.csv(str(tmp_path / "sample"), header=True).count() == 50
    encoded = encoding.encode_events(events)
    writers.write_encoded_csv(encoded, str(tmp_path / "encoded"))
    assert same(readers.read_encoded_csv(spark, str(tmp_path / "encoded")), encoded)


def test_a_code_log_stays_short(spark, tmp_path, monkeypatch):
    """Any chunk reads a snapshot and the few chunks after it, and gives codes no chunk before it gave."""
    monkeypatch.setattr(ingest, "COMPACT_CHUNKS", 4)
    path = str(tmp_path / "codes")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "Source string")
    start = encoding.fit_dictionary(one("A", None), "Source")
    expected = {"A": 0, None: 1}
    for number in range(11):
        names = [f"n{number}", f"m{number}", "A", "n0"]
        made = ingest._extended(start, one(*names, None), number, path)
        for name in sorted({n for n in names if n not in expected}):
            expected[name] = len(expected)
        assert {r["value"]: r["code"] for r in made.table.collect()} == expected
        assert len(ingest._log_folders(spark, path, number)) <= 4
    # A chunk that is repeated gives the same codes, whatever later ones left behind.
    again = ingest._extended(start, one("n9", "m9", "A", "n0", None), 9, path)
    assert {r["value"]: r["code"] for r in again.table.collect()} == {v: c for v, c in expected.items() if c < expected["n9"] + 1}


def test_a_damaged_code_log_is_an_error(spark, tmp_path):
    dictionary = encoding.fit_dictionary(spark.createDataFrame([("A",)], "Source string"), "Source")
    assert ingest.added_codes(spark, dictionary, str(tmp_path / "none"), 3).collect() == []
    folder = tmp_path / "codes" / "chunk=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet|part-0"):
        ingest.added_codes(spark, dictionary, str(tmp_path / "codes"), 3).collect()
