"""Training runs on a table whose label follows from its features."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from eventloom.operators import boosting, encoding, models, networks, search, splits, windows
from eventloom.plans import training
from eventloom.session import materialize, placed
from eventloom.sources import writers


@pytest.fixture(scope="module")
def events(spark):
    """Four classes, 0, 1, 2 and 5, told apart by two features; a third is noise."""
    a, b = F.col("id") % 7, (F.col("id") * 13) % 11
    label = F.when(a < 3, F.when(b < 5, 0).otherwise(1)).otherwise(F.when(b < 5, 2).otherwise(5))
    df = spark.range(1200).select(
        F.col("id").alias("rid"), a.cast("int").alias("a"), b.cast("int").alias("b"),
        (F.xxhash64("id") % 5).cast("int").alias("noise"), label.alias("CAMEOCode"),
    )
    return materialize(df, "learnable")


def check(run, events, low):
    rows = run.predictions.collect()
    score = run.scores.first()
    assert score["n"] == len(rows) > 0
    assert {r["prediction"] for r in rows} <= {float(i) for i in range(23)}
    majority = events.groupBy("CAMEOCode").count().agg(F.max("count")).first()[0] / events.count()
    assert score["accuracy"] > max(majority, low)


def test_holdout_boosting(events):
    run = training.holdout_boosting(events, "rid", maxIter=4)
    check(run, events, 0.9)
    _, test = splits.holdout_split(events, "rid", 0.2, 100)
    assert sorted(r["rid"] for r in run.predictions.collect()) == sorted(r["rid"] for r in test.collect())
    summary = models.model_summary(run.model).collect()
    assert len(summary) == 6 and all(r["kind"] == "GBTClassificationModel" and r["trees"] == 4 for r in summary)
    history = models.boosting_history(run.model, models.with_label(test))
    losses = [r["loss"] for r in history.where("class = 0").orderBy("iteration").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]


def test_scores_equal_the_models_own_transform(events):
    train, test = splits.holdout_split(models.with_label(events), "rid")
    model = models.boosting_pipeline(["a", "b", "noise"], rows=1000, maxIter=2).fit(train)
    ours = models.score(model, test).select("rid", "prediction")
    theirs = model.transform(test).select("rid", "prediction")
    assert ours.exceptAll(theirs).isEmpty() and ours.count() == test.count()
    assert "Python" not in ours._jdf.queryExecution().executedPlan().toString()


def test_search_tunes_the_boosted_trees(events):
    folds = materialize(splits.stratified_folds(models.with_label(events), "rid", 2), "folds")
    pipeline = models.boosting_pipeline(["a", "b"], maxIter=1)
    trees = pipeline.getStages()[-1].getClassifier()
    grid = search.full_grid({"minSplitGain": [600.0, 0.0], "maxDepth": [3]})
    best, results = search.grid_search(pipeline, trees, folds, "rid", grid, k=2)
    assert [r["rank_test_score"] for r in results.orderBy("candidate").collect()] == [2, 1]
    assert best.stages[-1].models[0].getOrDefault("minInfoGain") == 0.0


def test_search_takes_the_configured_grid(events):
    folds = materialize(splits.stratified_folds(models.with_label(events), "rid", 2), "folds")
    pipeline = models.boosting_pipeline(["a", "b"])
    grid = [{**c, "maxIter": 1} for c in search.sample_grid(2, 1)]
    _, results = search.grid_search(pipeline, pipeline.getStages()[-1].getClassifier(), folds, "rid", grid, k=2)
    assert results.count() == 2 and "param_minSplitGain" in results.columns


def test_ranks_of_ties(spark):
    results = search.search_results(spark.range(1), [{"x": i} for i in range(4)], [[0.5], [0.9], [0.9], [0.1]])
    assert [r["rank_test_score"] for r in results.orderBy("candidate").collect()] == [3, 1, 1, 4]


def test_models_do_not_depend_on_cores(events):
    def trained(frame):
        train, test = splits.holdout_split(models.with_label(frame), "rid")
        forest = models.forest_pipeline(["a", "b", "noise"], numTrees=3, maxDepth=3)
        model = forest.fit(placed(train, "rid"))
        return sorted((r["rid"], r["prediction"]) for r in models.predict(model, test, ["rid"]).collect())

    assert trained(events.repartition(2)) == trained(events.repartition(9, "noise"))


def test_indexed_boosting(events):
    run = training.indexed_boosting(events, "rid", iterations=3)
    check(run, events, 0.9)
    assert models.test_error(run.predictions) == pytest.approx(run.scores.first()["test_error"])
    assert [r["rid"] for r in models.preview(run.predictions, ["rid"]).collect()] == sorted(
        r["rid"] for r in run.predictions.collect()
    )[:5]


def test_ensembles_at_a_time_fit_into_memory(spark, events, monkeypatch):
    """Small tables are fitted as asked; where memory holds the rows of one ensemble, one at a time, with the same trees."""
    assert models.storage_bytes(spark) > 1 << 30
    assert models.ensembles_at_once(100_000, 11, 8, 1 << 32) == 8
    # Six times a 1 GB table on three executors: eight copies would not be kept.
    assert 1 <= models.ensembles_at_once(33_000_000, 11, 8, 3 * 6 << 30) <= 2
    assert models.ensembles_at_once(10**12, 11, 8, 1 << 30) == 1 and models.ensembles_at_once(0, 0, 3, 0) == 1
    asked, own = [], training.indexed_boosting_pipeline
    monkeypatch.setattr(training, "indexed_boosting_pipeline", lambda *a, **o: asked.append(o["parallelism"]) or own(*a, **o))
    many = training.indexed_boosting(events, "rid", iterations=2, parallelism=3)
    monkeypatch.setattr(training, "storage_bytes", lambda _: 840 * 160)
    one = training.indexed_boosting(events, "rid", iterations=2, parallelism=3)
    assert asked == [3, 1]
    trees = [[t.toDebugString.split("\n", 1)[1] for t in run.model.stages[-1].models] for run in (many, one)]
    assert trees[0] == trees[1] and len(trees[0]) == 4


def test_forest_reloads_with_equal_predictions(events, tmp_path):
    train, test = splits.holdout_split(models.with_label(events), "rid")
    model, scores = models.fit_with_validation(models.forest_pipeline(["a", "b", "noise"]), train, test)
    assert {r["part"]: r["accuracy"] > 0.9 for r in scores.collect()} == {"train": True, "validation": True}
    writers.save_model(model, str(tmp_path / "model"))
    again = writers.load_model(str(tmp_path / "model"))
    first, second = (models.predict(m, test, ["rid"]) for m in (model, again))
    assert first.exceptAll(second).isEmpty() and first.count() == test.count()
    writers.write_predictions(model.transform(test), str(tmp_path / "predictions"), ["rid"])
    stored = test.sparkSession.read.parquet(str(tmp_path / "predictions"))
    assert stored.columns == ["rid", "label", "prediction", "probability"] and stored.count() == test.count()


def test_dense_network(events, tmp_path):
    run, history, scores = training.dense_network(events, "rid", iterations=60)
    check(run, events, 0.9)
    objectives = [r["objective"] for r in history.orderBy("iteration").collect()]
    assert len(objectives) > 20 and objectives[-1] < objectives[0] / 3
    found = {r["part"]: r["accuracy"] for r in scores.collect()}
    assert found["validation"] == pytest.approx(run.scores.first()["accuracy"]) and found["train"] > 0.9
    writers.save_model(run.model, str(tmp_path / "network"))
    _, test = splits.holdout_split(models.with_label(events), "rid", 0.2, 42)
    again = models.predict(writers.load_model(str(tmp_path / "network")), test, ["rid"])
    assert again.exceptAll(run.predictions).isEmpty() and again.count() == run.predictions.count()


def test_bounds_of_all_rows(events):
    far = events.withColumn("a", F.when(F.col("rid") == one_test_row(events), 1000).otherwise(F.col("a")))
    bounds = [
        training.dense_network(far, "rid", iterations=1, fit_on=part)[0].model.stages[1].originalMax.toArray().max()
        for part in ("train", "all")
    ]
    assert bounds[0] < 1000 and bounds[1] == 1000


def one_test_row(events):
    return splits.holdout_split(events, "rid", 0.2, 42)[1].first()["rid"]


def test_network_pipelines_and_history(events):
    train, test = splits.holdout_split(models.with_label(events), "rid")
    pipeline = models.dense_network_pipeline(["a", "b", "noise"], iterations=40)
    model = pipeline.fit(train)
    history = [r["objective"] for r in models.training_history(model).orderBy("iteration").collect()]
    assert len(history) > 5 and history[-1] < history[0]
    assert models.test_error(model.transform(test)) < 0.4
    assert models.model_summary(model).first()["size"] == 3 * 64 + 64 + 64 * 64 + 64 + 64 * 23 + 23


def test_sequence_network(spark):
    """Each label repeats the one two steps back, so the windows hold the answer."""
    cycle = F.col("id") % 2
    df = spark.range(600).select("id", F.lit("x").alias("who"), cycle.cast("int").alias("CAMEOCode"))
    made = materialize(windows.lag_windows(df, ["who"], ["id"], ["CAMEOCode"], look_back=4), "windows")
    _, scores = training.sequence_network(
        made, ["id"], 1, look_back=4, holdout=100, classes=2, iterations=30
    )
    found = {r["part"]: (r["n"], r["accuracy"]) for r in scores.collect()}
    assert found["validation"] == (100, 1.0) and found["train"][0] == 496


def test_cross_validation_leaves_the_label_out(events):
    scores = training.cross_validated_boosting(events, "rid", k=2, maxIter=3)
    rows = scores.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 1] and sum(r["n"] for r in rows) == events.count()
    assert all(0.8 < r["accuracy"] <= 1 for r in rows)


def test_grid_search(events):
    folds = materialize(splits.stratified_folds(models.with_label(events), "rid", 3), "folds")
    forest = models.forest_pipeline(["a", "b", "noise"], numTrees=3)
    grid = search.full_grid({"maxDepth": [1, 5]})
    found, results = search.grid_search(forest, forest.getStages()[-1], folds, "rid", grid, k=3)
    rows = results.orderBy("candidate").collect()
    assert [r["param_maxDepth"] for r in rows] == ["1", "5"] and [r["rank_test_score"] for r in rows] == [2, 1]
    assert search.best_parameters(results).first()["candidate"] == 1
    splits_of_best = [rows[1][f"split{i}_test_score"] for i in range(3)]
    assert sum(splits_of_best) / 3 == pytest.approx(rows[1]["mean_test_score"])
    assert rows[1]["normalized_score"] == pytest.approx(2 * rows[1]["mean_test_score"] - 1)
    assert found.stages[-1].getOrDefault("maxDepth") == 5


def test_grid_of_the_boosting_parameters():
    assert search.grid_size() == 12_960
    drawn = search.sample_grid(5, seed=1009)
    assert len({tuple(c.items()) for c in drawn}) == 5 and drawn == search.sample_grid(5, seed=1009)
    assert all(c[name] in values for c in drawn for name, values in search.GRID.items())
    found = search.spark_parameters({"minSplitGain": 5.0, "maxDepth": 3}, 1000)
    assert found == {"minInfoGain": 0.005, "maxDepth": 3}


def test_category_index_leaves_many_valued_features_alone(events):
    vectors = encoding.assemble(events.withColumn("few", F.col("noise") * 10), ["few", "b"])
    maps = encoding.fit_category_index(vectors, max_categories=9).categoryMaps
    assert list(maps) == [0]


def test_halving_finds_what_a_full_search_finds(spark, events):
    """Survivors have the scores and the order of a search that drops nobody; the dropped have none."""
    folds = materialize(splits.quantile_folds(models.with_label(events), "rid", 2), "folds")
    grid = search.full_grid({"stepSize": [0.05, 0.2, 0.6], "minSplitGain": [0.0, 400.0], "maxDepth": [2, 3], "maxIter": [1, 4]})
    base = boosting.replace(boosting.CONFIGURED, least_weight=1.0, rows=1.0, columns=1.0)
    options = {"k": 2, "first_rounds": 1, "base": base}
    full = search.halving_search(folds, "rid", ["a", "b", "noise"], grid, keep=1.0, **options)
    fast = search.halving_search(folds, "rid", ["a", "b", "noise"], grid, keep=0.25, **options)
    all_rows = {r["candidate"]: r for r in full.results.collect()}
    rows = {r["candidate"]: r for r in fast.results.collect()}
    assert len(rows) == len(all_rows) == 24 and all(r["mean_test_score"] is not None for r in all_rows.values())
    scored = [c for c, r in rows.items() if r["mean_test_score"] is not None]
    for c in scored:
        assert rows[c]["mean_test_score"] == all_rows[c]["mean_test_score"] and rows[c]["split0_test_score"] == all_rows[c]["split0_test_score"]
    by_rank = lambda table: sorted(scored, key=lambda c: (table[c]["rank_test_score"], c))
    assert by_rank(rows) == by_rank(all_rows)
    assert [(r["rounds"], r["candidates"], r["fits"]) for r in fast.rungs.collect()] == [(1, 12, 24), (4, 3, 6)]
    assert [(r["rounds"], r["candidates"]) for r in full.rungs.collect()] == [(4, 12)]
    assert fast.passes < full.passes
    # Every one-round combination was scored, and three candidates went on.
    assert len(scored) == 12 + 3
    assert len(fast.best.trees) == grid[search.best_parameters(fast.results).first()["candidate"]]["maxIter"]


def test_network_over_stored_blocks(spark):
    rows = spark.range(900).select((F.col("id") % 3).alias("who"), F.col("id").alias("at"), (F.col("id") % 7 / 7).alias("x"), (F.col("id") % 5 >= 2).cast("int").alias("label"))
    blocks = materialize(windows.sequence_blocks(rows, ["who"], ["at"], ["x"], "label", 4, block_rows=50), "blocks")
    model, scores = training.block_network(blocks, ["who"], ["at"], 1, 4, holdout=100, classes=2, iterations=5)
    assert {r["part"]: r["n"] for r in scores.collect()} == {"train": 900 - 12 - 100, "validation": 100}
    again = training.block_network(blocks.repartition(3), ["who"], ["at"], 1, 4, holdout=100, classes=2, iterations=5)[0]
    assert model.stages[-1].weights.toArray() == pytest.approx(again.stages[-1].weights.toArray(), abs=1e-9)


def test_network_in_stages(events):
    run, curve = training.staged_network(events, "rid", iterations=10, every=4)
    rows = curve.orderBy("iteration", "part").collect()
    assert [(r["iteration"], r["part"]) for r in rows] == [(i, p) for i in (4, 8, 10) for p in ("train", "validation")]
    train = [r["loss"] for r in rows if r["part"] == "train"]
    assert train == sorted(train, reverse=True) and rows[-1]["accuracy"] == pytest.approx(run.scores.first()["accuracy"])


def test_network_stops_early(spark, events):
    """Validation labels are noise: the least loss comes early, and the model is that one."""
    table = models.with_label(events)
    noise = table.withColumn("label", (F.xxhash64("rid") % 2 + 3).cast("double"))
    pipeline = models.dense_network_pipeline(["a", "b"], 6, hidden=(8,), iterations=60)
    model, curve = models.fit_in_stages(pipeline, placed(table, "rid"), noise, 5, patience=2)
    losses = [r["loss"] for r in curve.where("part = 'validation'").orderBy("iteration").collect()]
    assert len(losses) < 12 and len(losses) - 1 - losses.index(min(losses)) == 2
    scored = model.transform(noise).select(vector_to_array("probability").alias("p"), "label")
    again = scored.agg(F.avg(-F.log(F.greatest(F.get("p", F.col("label").cast("int")), F.lit(1e-16))))).first()[0]
    assert again == pytest.approx(min(losses))


def test_network_of_batches_is_sparks_own(events):
    """First weights, objective and steps are those of Spark's learner, stacks that are not full included."""
    rows = placed(models.with_label(events), "rid", 3)
    pipeline = models.dense_network_pipeline(["a", "b", "noise"], 6, hidden=(8, 4), iterations=12, blockSize=50)
    ours, theirs = models.fit(pipeline, rows), pipeline.fit(rows)
    found, expected = ([r["objective"] for r in models.training_history(m).collect()] for m in (ours, theirs))
    assert len(found) == 13 and found == pytest.approx(expected, abs=1e-9)
    assert ours.stages[-1].weights.toArray() == pytest.approx(theirs.stages[-1].weights.toArray(), abs=1e-7)
    assert ours.stages[-1].getMaxIter() == 12


def test_windows_of_batches_are_the_blocks_own(spark):
    """Batches keep each row about once, and a window has the numbers that Spark's pipeline gives the network."""
    rows = spark.range(2000).select((F.col("id") % 9).alias("who"), F.col("id").alias("at"), (F.col("id") % 7 / 7).alias("x"), F.lit(3.0).alias("same"), (F.col("id") % 5 >= 2).cast("int").alias("label"))
    blocks = materialize(windows.sequence_blocks(rows, ["who"], ["at"], ["x", "same"], "label", 4, block_rows=30), "blocks")
    first = windows.tail_start(windows.block_keys(blocks, ["at"], 4), ["at"], 100)
    train, test = windows.split_at(windows.block_windows(blocks, ["who"], ["at"], 2, 4, flat=True), ["at"], first)
    assert test.count() == 100
    pipeline = models.sequence_network_pipeline(8, 2, hidden=(4,), iterations=1)
    scaler, network = pipeline.getStages()
    vectors = windows.flatten_windows(train)
    fitted = scaler.fit(vectors)
    stored = networks.window_batches(windows.blocks_before(blocks, ["at"], first, 4), network, 4, fitted).table.collect()
    scale = networks.window_batches(windows.blocks_before(blocks, ["at"], first, 4), network, 4, fitted)
    found = []
    for r in stored:
        data, starts, labels = np.frombuffer(r["data"]), np.frombuffer(r["starts"], np.int32), np.frombuffer(r["labels"], np.int32)
        cut = (networks._windows(data, 2, 4)[starts] - scale.low) * scale.scale + scale.least
        found += [(*w.round(9).tolist(), int(y)) for w, y in zip(cut, labels)]
    expected = fitted.transform(vectors).select(vector_to_array("scaled").alias("w"), "label").collect()
    assert sorted(found) == sorted((*np.round(r["w"], 9).tolist(), r["label"]) for r in expected)
    assert sum(len(r["data"]) for r in stored) <= 8 * 2 * sum(len(r["labels"]) for r in blocks.collect())


def test_network_refuses_what_is_no_class_or_number(events):
    pipeline = models.dense_network_pipeline(["a", "b"], 6, hidden=(4,), iterations=2)
    for odd in (F.lit(6.0), F.lit(0.5), F.lit(None).cast("double"), F.lit(-1.0)):
        table = models.with_label(events).withColumn("label", F.when(F.col("rid") == 7, odd).otherwise(F.col("label")))
        with pytest.raises(Exception, match="no class"):
            models.fit(pipeline, table)
    with pytest.raises(ValueError, match="no rows"):
        batches = networks.row_batches(models.with_label(events).limit(0).withColumn("scaled", array_to_vector(F.array("a", "b").cast("array<double>"))), pipeline.getStages()[-1])
        networks.fit_network(pipeline.getStages()[-1], batches)


def test_search_for_a_step_as_in_sparks_learner():
    """Rosenbrock's valley: to the bottom, never upwards, and no further than asked."""
    def f(x):
        a, b = 1 - x[0], x[1] - x[0] ** 2
        return a * a + 100 * b * b, np.array([-2 * a - 400 * x[0] * b, 200 * b])

    x, values = networks.minimize(f, np.array([-1.2, 1.0]), 200, 1e-12)
    assert x == pytest.approx([1, 1], abs=1e-4) and values == sorted(values, reverse=True)
    assert len(networks.minimize(f, np.array([-1.2, 1.0]), 5, 1e-12)[1]) == 6
    assert networks.minimize(f, np.array([1.0, 1.0]), 5, 1e-6)[1] == [0.0]
