"""Whole training runs: split, fit, predict, score.

Each run stores its model table first. Fitting reads the data many times; it should read a
narrow table, not repeat the encoding. Training rows are placed by their key, so that a model
does not depend on the number of cores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.boosting import CONFIGURED, DEFAULTS, Job, Parameters, fit_boosting
from eventloom.operators.cleaning import drop_leaky, feature_columns
from eventloom.operators.encoding import assemble, fit_label_index
from eventloom.operators.evaluation import accuracy
from eventloom.operators.models import (
    DENSE_ITERATIONS,
    boosting_pipeline,
    default_boosting_pipeline,
    dense_network_pipeline,
    ensembles_at_once,
    feature_scaler,
    fit_in_stages,
    fit_with_validation,
    indexed_boosting_pipeline,
    predict,
    sequence_network_pipeline,
    storage_bytes,
    training_history,
    validated,
    with_label,
    with_objective,
)
from eventloom.operators.networks import fit_network, window_batches
from eventloom.operators.search import cross_validate
from eventloom.operators.splits import holdout_split, quantile_folds, random_split, stratified_folds, with_test_flag
from eventloom.operators.windows import (
    block_keys,
    block_windows,
    blocks_before,
    flatten_windows,
    split_at,
    tail_holdout,
    tail_start,
)
from eventloom.schemas import LABEL, LOOK_BACK, NUM_CLASSES
from eventloom.session import FIT_PARTITIONS, cut_lineage, materialize, placed


@dataclass(frozen=True)
class Run:
    """A fitted model, its test predictions and their accuracy."""

    model: Any
    predictions: DataFrame
    scores: DataFrame


def _run(estimator: Estimator, train: DataFrame, test: DataFrame, key: str, label: str = "label") -> Run:
    cut_lineage(train.sparkSession)
    model = estimator.fit(placed(train, key))
    predictions = predict(model, test, [key], label)
    return Run(model, predictions, accuracy(predictions))


def holdout_boosting(events: DataFrame, key: str, seed: int = 100, **overrides: Any) -> Run:
    """Boosted trees on 80 % of the events, tested on the rest."""
    table = materialize(with_label(drop_leaky(events)), "model-table")
    train, test = holdout_split(table, key, 0.2, seed)
    features = feature_columns(drop_leaky(events), exclude=[key])
    rows = train.count()
    pipeline = boosting_pipeline(features, rows=rows, **_at_once(train, rows, features, overrides))
    return _run(pipeline, train, test, key)


def _at_once(train: DataFrame, rows: int, features: Sequence[str], overrides: dict[str, Any]) -> dict[str, Any]:
    """The overrides, with no more ensembles at a time than executors can keep rows of."""
    storage = storage_bytes(train.sparkSession)
    return {**overrides, "parallelism": ensembles_at_once(rows, len(features), overrides.get("parallelism", 4), storage)}


def indexed_boosting(events: DataFrame, key: str, seed: int = 0, **overrides: Any) -> Run:
    """Boosted trees on frequency-indexed labels, 70 % train and 30 % test.

    The label index is fitted on all events, so that it knows every class.
    """
    table = materialize(events, "model-table")
    indexer = fit_label_index(table, LABEL, "label")
    features = feature_columns(table, exclude=[key])
    train, test = random_split(table, key, (0.7, 0.3), seed)
    overrides = _at_once(train, train.count(), features, overrides)
    return _run(indexed_boosting_pipeline(indexer, features, **overrides), train, test, key)


def dense_network(
    events: DataFrame, key: str, seed: int = 42, iterations: int = DENSE_ITERATIONS, fit_on: str = "train"
) -> tuple[Run, DataFrame, DataFrame]:
    """Dense network on scaled features; its run, its history, and its scores on both parts.

    The scaling bounds come from the training part, or from all rows with ``fit_on="all"``;
    the model carries them. It is one fit, validated on a 20 % hold-out at its end.
    """
    features = feature_columns(drop_leaky(events), exclude=[key])
    table = materialize(with_label(drop_leaky(events)), "model-table")
    train, test = holdout_split(table, key, 0.2, seed)
    scaler = feature_scaler().fit(assemble(table, features)) if fit_on == "all" else None
    network = dense_network_pipeline(features, NUM_CLASSES, iterations=iterations, scaler=scaler)
    model, scores = fit_with_validation(network, train, test, key=key)
    predictions = predict(model, test, [key])
    return Run(model, predictions, accuracy(predictions)), training_history(model), scores


def staged_network(
    events: DataFrame, key: str, seed: int = 42, iterations: int = DENSE_ITERATIONS, every: int = 4, patience: int | None = None
) -> tuple[Run, DataFrame]:
    """The dense network with its loss and accuracy on both parts after every few iterations."""
    features = feature_columns(drop_leaky(events), exclude=[key])
    table = materialize(with_label(drop_leaky(events)), "model-table")
    train, test = holdout_split(table, key, 0.2, seed)
    network = dense_network_pipeline(features, NUM_CLASSES, iterations=iterations)
    model, curve = fit_in_stages(network, train, test, every, patience, key=key)
    predictions = predict(model, test, [key])
    return Run(model, predictions, accuracy(predictions)), curve


def sequence_network(
    windows: DataFrame,
    order: Sequence[str],
    features: int,
    look_back: int = LOOK_BACK,
    holdout: int = 300,
    classes: int = NUM_CLASSES,
    **parameters: Any,
) -> tuple[PipelineModel, DataFrame]:
    """Network over stored windows, validated on the last ``holdout`` of them.

    The last of the ``order`` columns must be unique. ``training_history`` of the model has
    the objective of every iteration.
    """
    train, test = tail_holdout(windows, order, holdout)
    train, test = (with_label(flatten_windows(part), "label") for part in (train, test))
    network = sequence_network_pipeline(look_back * features, classes, **parameters)
    return fit_with_validation(network, train, test, key=order[-1])


def block_network(
    blocks: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    features: int,
    look_back: int = LOOK_BACK,
    holdout: int = 300,
    classes: int = NUM_CLASSES,
    **parameters: Any,
) -> tuple[PipelineModel, DataFrame]:
    """As ``sequence_network``, over stored blocks: windows are cut in the task that reads a block.

    What is placed, shuffled and stored for the fit are the blocks, not the windows, which have every row ``look_back`` times.
    """
    first = tail_start(block_keys(blocks, order, look_back), order, holdout)
    train, test = split_at(block_windows(blocks, by, order, features, look_back, flat=True), order, first)
    train, test = (with_label(flatten_windows(part), "label") for part in (train, test))
    *before, network = sequence_network_pipeline(look_back * features, classes, **parameters).getStages()
    prepared = Pipeline(stages=before).fit(train)
    rows = blocks_before(placed_blocks(blocks, by), order, first, look_back)
    fitted, values = fit_network(network, window_batches(rows, network, look_back, prepared.stages[-1]))
    model = with_objective(PipelineModel(stages=[*prepared.stages, fitted]), values)
    return model, validated(model, train, test)


def placed_blocks(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored blocks by hash of actor and number, in their order, whatever the cluster."""
    keys = [*by, "block"]
    return blocks.repartition(FIT_PARTITIONS, *keys).sortWithinPartitions(*keys)


def multiclass_boosting(
    events: DataFrame, key: str, seed: int = 100, parameters: Parameters = CONFIGURED, patience: int | None = None
) -> tuple[Run, DataFrame]:
    """Trees of all classes on 80 % of the events, tested on the rest; and the curve of both parts.

    With ``patience``, the fit ends when the loss of the rest has not fallen for so many rounds, and
    the model has the rounds up to the least.
    """
    table = materialize(with_label(drop_leaky(events)), "model-table")
    flagged = with_test_flag(table, key, 0.2, seed).withColumn("is_test", F.col("is_test").cast("int"))
    features = feature_columns(drop_leaky(events), exclude=[key])
    fit = fit_boosting(flagged, key, features, [Job(parameters, holdout=1)], fold="is_test", classes=NUM_CLASSES, patience=patience)
    model = fit.fitted(best=patience is not None)
    _, test = holdout_split(table, key, 0.2, seed)
    predictions = model.transform(test).select(key, "label", "prediction")
    return Run(model, predictions, accuracy(predictions)), fit.curve()


def cross_validated_trees(
    events: DataFrame, key: str, k: int = 2, parameters: Parameters = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(fold, n, accuracy, test_error) per stratified fold, all folds in one fit, and their curves.

    The label is not among the features.
    """
    features = feature_columns(events, exclude=[key])
    table = materialize(quantile_folds(with_label(events), key, k), "model-table")
    fit = fit_boosting(table, key, features, [Job(parameters, fold) for fold in range(k)], fold="fold", classes=NUM_CLASSES)
    last = [h for h in fit.history if h[1] == parameters.rounds and h[2] == "validation"]
    rows = [(m, n, right, 1 - right) for m, _, _, n, _, right in last]
    return events.sparkSession.createDataFrame(rows, "fold int, n long, accuracy double, test_error double"), fit.curve()


def cross_validated_boosting(events: DataFrame, key: str, k: int = 2, **overrides: Any) -> DataFrame:
    """Accuracy per stratified fold of boosted trees with the library's defaults.

    The label is not among the features.
    """
    features = feature_columns(events, exclude=[key])
    table = materialize(stratified_folds(with_label(events), key, k), "model-table")
    return cross_validate(default_boosting_pipeline(features, **overrides), table, key, k)
