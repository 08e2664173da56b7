"""Scores of prediction tables, computed where the predictions are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.events import round_prediction


def predictions_table(
    predictions: DataFrame, key: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Key, true label and rounded prediction."""
    return predictions.select(
        *key,
        F.col(label).cast("double").alias("label"),
        round_prediction(F.col(prediction).cast("double")).alias("prediction"),
    )


def accuracy(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Share of equal label and prediction, the test error, and the number of rows."""
    equal = F.col(label).cast("double") == F.col(prediction).cast("double")
    scores = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(equal.cast("double")).alias("accuracy")
    )
    return scores.withColumn("test_error", 1 - F.col("accuracy"))


def mean_score(fold_scores: DataFrame, by: Sequence[str] = (), score: str = "accuracy") -> DataFrame:
    """Mean and population deviation of a score over folds."""
    return fold_scores.groupBy(*by).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score")
    )
