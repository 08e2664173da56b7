"""Positions, first rows and windows: the split ways give what the plain ones give."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators import ordering, windows
from eventloom.session import materialize

ORDER = ["day", "rid"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    actors = ["USA"] * 5 + [None, "A", "B", "C"] + [f"N{i}" for i in range(40)]
    return [(i, rng.choice(actors), f"2001{rng.randint(1, 3):02d}01", rng.randint(0, 4), rng.random()) for i in range(2500)]


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "rid int, actor string, day string, label int, x double").repartition(7).cache()


def sequences(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    return groups


@pytest.mark.parametrize("hot_rows", [10**6, 100, 30])
def test_number_rows(events, rows, hot_rows):
    found = {r["rid"]: r["seq"] for r in ordering.number_rows(events, ["actor"], ORDER, hot_rows=hot_rows).collect()}
    expected = {r[0]: i for group in sequences(rows).values() for i, r in enumerate(group)}
    assert found == expected


@pytest.mark.parametrize("hot_rows", [10**6, 64])
def test_number_all_rows(events, rows, hot_rows):
    found = ordering.number_rows(events, [], ORDER, hot_rows=hot_rows).orderBy("seq").collect()
    assert [r["rid"] for r in found] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]


@pytest.mark.parametrize("n", [0, 1, 700, 2499, 2500, 9999])
def test_head(events, rows, n, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_N", 0)
    monkeypatch.setattr(ordering, "SORT_ROWS", 50)
    expected = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))][:n]
    found = ordering.head(events, ORDER, n)
    assert sorted(r["rid"] for r in found.collect()) == sorted(expected)
    assert [r["rid"] for r in ordering.head(events, ["x"], n).orderBy("x").collect()] == [
        r[0] for r in sorted(rows, key=lambda r: r[4])
    ][:n]


@pytest.mark.parametrize("n", [9_000, 10_000, 10_001, 14_999, 15_000])
def test_head_of_ties_has_n_rows_at_every_size(spark, n):
    df = spark.range(15_000).select((F.col("id") % 3).alias("k"), "id")
    for sort_rows in (50, 12_000):
        found = ordering.head(df, ["k"], n, sort_rows=sort_rows)
        assert found.select("id").distinct().count() == n
        assert {r["k"]: r["count"] for r in found.groupBy("k").count().collect()} == {
            k: min(5000, n - 5000 * k) for k in range(3) if n > 5000 * k
        }
        assert [r["k"] for r in found.collect()] == sorted(r["k"] for r in found.collect())


def test_head_of_equal_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    assert ordering.head(df, ["k"], 2000, top_n=0, sort_rows=100).count() == 2000


def test_head_of_times_when_clocks_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        # Every second of the nights in which an hour comes twice or never.
        start = F.when(F.col("id") < 15_000, F.lit(1_635_634_800)).otherwise(F.lit(1_616_880_000))
        df = spark.range(30_000).select("id", F.timestamp_seconds(start + F.col("id") % 15_000).alias("ts"))
        by_time = [r["id"] for r in df.orderBy("ts").collect()]
        for n in (19_900, 20_500, 29_999):
            found = ordering.head(df, ["ts"], n, top_n=10, sort_rows=1000)
            assert [r["id"] for r in found.collect()] == by_time[:n]
        numbered = ordering.number_rows(df, [], ["ts"], hot_rows=1000)
        assert [r["id"] for r in numbered.orderBy("seq").collect()] == by_time
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_every_group_above_the_limit_is_split(spark, monkeypatch):
    """However many there are, and however long the list of them."""
    monkeypatch.setattr(ordering, "MAX_HOT_GROUPS", 3)
    df = spark.range(4000).select("id", (F.col("id") % 20).alias("g"))
    load = ordering.group_load(df, ["g"])
    assert ordering.hot_groups(df, ["g"], 100, load).count() == 20
    ranged = ordering._with_ranges(df, ["g"], ["id"], 100, load, None)
    largest = ranged.groupBy("__group", "__range").count().agg(F.max("count")).first()[0]
    assert largest <= 100
    found = {r["id"]: r["seq"] for r in ordering.number_rows(df, ["g"], ["id"], hot_rows=100).collect()}
    assert found == {i: i // 20 for i in range(4000)}


def test_head_with_nulls_first(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_N", 0)
    monkeypatch.setattr(ordering, "SORT_ROWS", 3)
    df = spark.createDataFrame([(i, None if i % 3 else i) for i in range(90)], "i int, v int")
    expected = sorted(range(90), key=lambda i: (i % 3 == 0, i))
    for n in (1, 30, 60, 61, 75):
        assert sorted(r["i"] for r in ordering.head(df, ["v", "i"], n).collect()) == sorted(expected[:n])


def expected_windows(rows, look_back):
    found = {}
    for actor, group in sequences(rows).items():
        for i in range(look_back, len(group)):
            before = [[r[4], float(r[3])] for r in group[i - look_back : i]]
            found[group[i][0]] = (actor, i, before, group[i][3])
    return found


@pytest.mark.parametrize("hot_rows,block_rows", [(10**6, 10**6), (40, 30), (40, 37), (10, 100)])
def test_lag_windows(events, rows, hot_rows, block_rows):
    made = windows.lag_windows(
        events, ["actor"], ORDER, ["x", "label"], "label", 30, hot_rows=hot_rows, block_rows=block_rows
    )
    found = {r["rid"]: (r["actor"], r["seq"], r["window"], r["label"]) for r in made.collect()}
    assert found == expected_windows(rows, 30)
    assert len(found) == sum(max(0, len(g) - 30) for g in sequences(rows).values())


def test_windows_do_not_depend_on_partitions(events):
    def make(df):
        return windows.lag_windows(df, ["actor"], ORDER, ["x"], "label", 5, hot_rows=50, block_rows=20)

    one, many = make(events.coalesce(1)), make(events.repartition(11, "x"))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_long_and_flat_windows(events):
    made = windows.lag_windows(events, ["actor"], ORDER, ["x", "label"], "label", 4).cache()
    long = windows.windows_long(made, ["rid"], ["x", "label"])
    assert long.count() == made.count() * 4 * 2
    row = windows.flatten_windows(made).first()
    assert row["features"].toArray().tolist() == [v for step in row["window"] for v in step]
    at = {(r["step"], r["feature"]): r["value"] for r in long.where(F.col("rid") == row["rid"]).collect()}
    assert at[2, "x"] == row["window"][2][0] and at[3, "label"] == row["window"][3][1]


def test_tail_holdout(events):
    made = windows.lag_windows(events, ["actor"], ORDER, ["x"], "label", 5).cache()
    train, test = windows.tail_holdout(made, ORDER, 300)
    assert test.count() == 300 and train.count() == made.count() - 300
    assert train.agg(F.max(F.struct(*ORDER))).first()[0] < test.agg(F.min(F.struct(*ORDER))).first()[0]
    everything, _ = windows.tail_holdout(made, ORDER, 300, include_in_train=True)
    assert everything.count() == made.count()
    train, test = windows.tail_holdout(made, ORDER, 10**6)
    assert train.isEmpty() and test.count() == made.count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=60
    ),
    hot_rows=st.sampled_from([1, 5]),
)
def test_number_rows_with_nulls_and_ties(spark, keys, hot_rows):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(keys)], "i int, g string, v int")
    plain = ordering.number_rows(df, ["g"], ["v", "i"])
    split = ordering.number_rows(df, ["g"], ["v", "i"], hot_rows=hot_rows)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_ranges_of_two_levels(spark, monkeypatch):
    """A table that needs more ranges than a plan may hold: each is still small, and numbers are right."""
    monkeypatch.setattr(ordering, "MAX_SPLITS", 4)
    df = spark.range(6000).select("id", F.when(F.col("id") % 11 == 0, None).otherwise(F.xxhash64("id") % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    load = ordering.group_load(df, [])
    ranged = ordering._with_ranges(df, [], ["v", "id"], 200, load, None)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert max(sizes) <= 300 and len(sizes) > 16
    for points in (10**6, 0):  # with the points broadcast, and joined
        monkeypatch.setattr(ordering, "MAX_POINTS", points)
        for by in ([], ["g"]):
            found = ordering.number_rows(df, by, ["v", "id"], hot_rows=200)
            plain = ordering.number_rows(df, by, ["v", "id"])
            assert found.exceptAll(plain).isEmpty() and found.count() == 6000


def test_running_sum_counts_ties_together(spark):
    df = spark.range(900).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"), (F.col("id") % 2).alias("x"))
    plain = {r["id"]: r["s"] for r in ordering.running_sum(df, ["g"], ["v"], "x", "s").collect()}
    rows = df.collect()
    assert plain == {r["id"]: sum(o["x"] for o in rows if o["g"] == r["g"] and o["v"] <= r["v"]) for r in rows}
    assert plain == {r["id"]: r["s"] for r in ordering.running_sum(df, ["g"], ["v"], "x", "s", hot_rows=40).collect()}
    assert sum(r["x"] for r in rows) == ordering.running_sum(df, [], ["v"], "x", "s", hot_rows=40).agg(F.max("s")).first()[0]


def test_buckets_stand_in_for_a_long_list_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_HOT_GROUPS", 3)
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 20).alias("g"))
    load = ordering.group_load(df, ["g"])
    marks = ordering.hot_marks(df, ["g"], 150, load)
    assert marks.by_bucket
    marked = marks.mark(df, ["g"], "hot")
    assert "SortMerge" not in marked._jdf.queryExecution().executedPlan().toString()
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert all(r["hot"] or sizes[r["g"]] <= 150 for r in marked.collect())
    assert marked.count() == 4000


@pytest.mark.parametrize("block_rows", [30, 37, 1024])
def test_windows_of_stored_blocks(events, rows, block_rows):
    blocks = windows.sequence_blocks(events, ["actor"], ORDER, ["x", "label"], "label", 30, hot_rows=40, block_rows=block_rows)
    made = windows.block_windows(blocks, ["actor"], ORDER, 2, 30)
    found = {r["rid"]: (r["actor"], r["seq"], r["window"], r["label"]) for r in made.collect()}
    assert found == expected_windows(rows, 30)
    flat = {r["rid"]: r["window"] for r in windows.block_windows(blocks, ["actor"], ORDER, 2, 30, flat=True).collect()}
    assert flat == {rid: [v for step in w[2] for v in step] for rid, w in found.items()}
    kept = blocks.agg(F.sum(F.size("labels"))).first()[0]
    assert kept <= len(rows) * (1 + 30 / block_rows)


def test_ranges_are_found_once(spark):
    """Counts of ranges and ranks read one stored table: a row's range is looked up once."""
    rows = materialize(spark.range(2000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("x"), F.lit(1).alias("one")), "range-input")
    for found in (ordering.number_rows(rows, ["g"], ["x"], hot_rows=100), ordering.running_sum(rows, ["g"], ["x"], "one", "seq", hot_rows=100)):
        assert found.inputFiles() and all("ranged-rows" in f for f in found.inputFiles())
        assert found.groupBy("g").agg(F.countDistinct("seq").alias("n"), (F.max("seq") - F.min("seq")).alias("d")).select("n", "d").distinct().first() == (1000, 999)


def test_a_large_actor_is_cut_into_many_blocks(spark):
    """Windows of one actor are made by more than one task long before its rows are too many for one."""
    rows = materialize(spark.range(12_000).select(F.lit("USA").alias("actor"), F.xxhash64("id").alias("rid"), F.col("id").cast("double").alias("x"), F.lit(1).alias("label")), "one-actor")
    made = windows.lag_windows(rows, ["actor"], ["rid"], ["x"], "label", 5)
    assert "__slot" in made._jdf.queryExecution().toString()
    at_once = windows.lag_windows(rows, ["actor"], ["rid"], ["x"], "label", 5, block_rows=1_000_000)
    assert made.count() == 11_995 and made.exceptAll(at_once).isEmpty()
