"""Classifiers, as Spark ML pipelines over feature columns.

The parameters are those of the modelled configurations, by their Spark names. Boosting
has no counterpart for L2 leaf regularisation, per-level column sampling or a step cap;
columns are sampled per node instead of per tree and the least child weight is a row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.encoding import assembler
from eventloom.operators.evaluation import accuracy
from eventloom.operators.networks import fit_network, row_batches
from eventloom.schemas import LABEL, NUM_CLASSES
from eventloom.session import materialize, placed

# The boosting configuration.
BOOSTING = {
    "maxIter": 100,
    "maxDepth": 3,
    "stepSize": 0.1,
    "subsamplingRate": 0.6,
    "featureSubsetStrategy": "0.5",
    "minInstancesPerNode": 10,
    "seed": 0,
}
# Fixed value: the least gain of a split, as a sum over the rows of the node.
MIN_SPLIT_GAIN = 5.0
# The library defaults of the boosting that is cross-validated.
DEFAULT_BOOSTING = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 0}
# Bytes that an ensemble's learner keeps of a row, and of each of its features.
ENSEMBLE_ROW, ENSEMBLE_FEATURE = 128, 8
# Hidden layers and passes of the dense and of the sequence network.
HIDDEN_LAYERS = (64, 64)
DENSE_ITERATIONS = 20
SEQUENCE_ITERATIONS = 500


def with_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add the class as the double column ``label`` that Spark ML trains on."""
    return df.withColumn("label", F.col(label).cast("double"))


def boosted_trees(label: str = "label", parallelism: int = 1, **parameters: Any) -> OneVsRest:
    """Boosted trees for many classes: one two-class ensemble per class."""
    trees = GBTClassifier(labelCol=label, **parameters)
    return OneVsRest(classifier=trees, labelCol=label, parallelism=parallelism)


def storage_bytes(spark: SparkSession) -> int:
    """What executors can keep of stored rows in memory; the driver's share of the sum is left out."""
    infos = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    sizes = [info.totalOnHeapStorageMemory() for info in infos]
    return sum(sizes) * max(len(sizes) - 1, 1) // max(len(sizes), 1)


def ensembles_at_once(rows: int, features: int, wanted: int, storage: int) -> int:
    """How many of ``wanted`` ensembles to fit at a time: each one keeps all rows, which must not push out each other's.

    A model is the same whatever is fitted beside it.
    """
    return max(1, min(wanted, storage // max(rows * (ENSEMBLE_ROW + ENSEMBLE_FEATURE * features), 1)))


def min_info_gain(split_gain: float, rows: int) -> float:
    """Spark's least gain is a mean per row; taken at the root, it is the sum over ``rows``."""
    return split_gain / max(rows, 1)


def boosting_pipeline(
    features: Sequence[str], rows: int | None = None, parallelism: int = 4, **overrides: Any
) -> Pipeline:
    """The full boosting configuration over plain feature columns and a ``label`` column.

    ``rows`` is the size of the training part, which the least split gain is relative to.
    """
    gain = min_info_gain(MIN_SPLIT_GAIN, rows) if rows else 0.0
    trees = boosted_trees(parallelism=parallelism, **{**BOOSTING, "minInfoGain": gain, **overrides})
    return Pipeline(stages=[assembler(features), trees])


def default_boosting_pipeline(features: Sequence[str], parallelism: int = 4, **overrides: Any) -> Pipeline:
    """Boosted trees as the library has them by default, for many classes."""
    return Pipeline(
        stages=[assembler(features), boosted_trees(parallelism=parallelism, **{**DEFAULT_BOOSTING, **overrides})]
    )


def indexed_boosting_pipeline(
    label_indexer: StringIndexer | StringIndexerModel,
    features: Sequence[str],
    iterations: int = 10,
    parallelism: int = 4,
    **overrides: Any,
) -> Pipeline:
    """Label index, feature vector, boosted trees. Give a fitted index so every label is known."""
    trees = boosted_trees(
        label_indexer.getOutputCol(), parallelism, maxIter=iterations, **overrides
    )
    return Pipeline(stages=[label_indexer, assembler(features), trees])


def forest_pipeline(features: Sequence[str], **parameters: Any) -> Pipeline:
    """Random forest, the one tree ensemble that handles many classes by itself."""
    forest = RandomForestClassifier(labelCol="label", **{"seed": 0, **parameters})
    return Pipeline(stages=[assembler(features), forest])


def dense_network_pipeline(
    features: Sequence[str],
    classes: int = NUM_CLASSES,
    hidden: Sequence[int] = HIDDEN_LAYERS,
    iterations: int = DENSE_ITERATIONS,
    scaler: MinMaxScaler | MinMaxScalerModel | None = None,
    **parameters: Any,
) -> Pipeline:
    """Scaled features into a feed-forward network.

    Bounds come from the training part, unless a fitted ``scaler`` (features to scaled) is given.
    """
    network = MultilayerPerceptronClassifier(
        labelCol="label",
        featuresCol="scaled",
        layers=[len(features), *hidden, classes],
        maxIter=iterations,
        **{"seed": 0, **parameters},
    )
    return Pipeline(stages=[assembler(features), scaler or feature_scaler(), network])


def feature_scaler() -> MinMaxScaler:
    return MinMaxScaler(inputCol="features", outputCol="scaled")


def sequence_network_pipeline(
    width: int,
    classes: int = NUM_CLASSES,
    hidden: Sequence[int] = HIDDEN_LAYERS,
    iterations: int = SEQUENCE_ITERATIONS,
    **parameters: Any,
) -> Pipeline:
    """Network over flattened look-back windows of ``width`` numbers in ``features``."""
    network = MultilayerPerceptronClassifier(
        labelCol="label",
        featuresCol="scaled",
        layers=[width, *hidden, classes],
        maxIter=iterations,
        **{"seed": 0, **parameters},
    )
    return Pipeline(stages=[feature_scaler(), network])


def score(model: Transformer, df: DataFrame) -> DataFrame:
    """``model.transform`` that stays in the JVM.

    One-versus-rest models are transformed by a Python function per class and row. Here
    their ensembles' raw scores are columns, and the prediction is the largest one.
    """
    if isinstance(model, PipelineModel):
        for stage in model.stages:
            df = score(stage, df)
        return df
    if not isinstance(model, OneVsRestModel):
        return model.transform(df)
    columns, raw = df.columns, []
    for i, ensemble in enumerate(model.models):
        raw.append(f"__raw_{i}")
        only_raw = {
            ensemble.rawPredictionCol: raw[i], ensemble.probabilityCol: "", ensemble.predictionCol: ""
        }
        df = ensemble.copy(only_raw).transform(df)
    scores = F.array(*[F.get(vector_to_array(F.col(c)), F.lit(1)) for c in raw])
    scored = df.select(*columns, scores.alias("__scores"))
    largest = F.array_position("__scores", F.array_max("__scores")) - 1
    return scored.withColumn(model.getPredictionCol(), largest.cast("double")).drop("__scores")


def is_network(estimator: Estimator) -> bool:
    """Whether a pipeline ends in a network that ``networks`` can fit."""
    last = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else None
    return isinstance(last, MultilayerPerceptronClassifier) and last.getSolver() == "l-bfgs"


def fit(estimator: Estimator, train: DataFrame, key: str | None = None) -> Transformer:
    """``estimator.fit``, of networks by passes over stored batches. Rows are placed by ``key``, if given."""
    rows = placed(train, key) if key else train
    if not is_network(estimator):
        return estimator.fit(rows)
    *before, network = estimator.getStages()
    prepared = Pipeline(stages=before).fit(train)
    model, values = fit_network(network, row_batches(prepared.transform(rows), network))
    return with_objective(PipelineModel(stages=[*prepared.stages, model]), values)


def with_objective(model: PipelineModel, values: Sequence[float]) -> PipelineModel:
    """Notes the objective of every iteration at a model, for ``training_history``."""
    model.objective = list(values)
    return model


def fit_with_validation(
    estimator: Estimator, train: DataFrame, validation: DataFrame, label: str = "label", key: str | None = None
) -> tuple[Transformer, DataFrame]:
    """The model and its accuracy on both parts: (part, n, accuracy, test_error)."""
    model = fit(estimator, train, key)
    return model, validated(model, train, validation, label)


def validated(model: Transformer, train: DataFrame, validation: DataFrame, label: str = "label") -> DataFrame:
    parts = [
        accuracy(score(model, part), label).select(F.lit(name).alias("part"), "*")
        for name, part in (("train", train), ("validation", validation))
    ]
    return parts[0].unionByName(parts[1])


def fit_in_stages(
    pipeline: Pipeline,
    train: DataFrame,
    validation: DataFrame,
    every: int,
    patience: int | None = None,
    label: str = "label",
    key: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fits the network that ends a pipeline ``every`` iterations at a time, validated after each stage.

    A stage starts from the weights of the one before; the learner's own memory of earlier steps begins
    anew. Returns the model and (iteration, part, n, loss, accuracy). With ``patience``, the fit
    ends when the validation loss has not fallen for so many stages, and the model is that of the least loss.
    The stages before the network are fitted once, and what they make of both parts is stored. Training rows are
    placed by ``key``, if given.
    """
    *before, network = pipeline.getStages()
    prepared = Pipeline(stages=before).fit(train)
    both = prepared.transform(train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation"))))
    parts = materialize(both.select("part", F.col(label), F.col(network.getFeaturesCol())), "network-parts")
    placed_rows = prepared.transform(placed(train, key) if key else train)
    batches = row_batches(placed_rows, network) if network.getSolver() == "l-bfgs" else None
    likelihood = F.get(vector_to_array(network.getProbabilityCol()), F.col(label).cast("int"))
    loss = F.avg(-F.log(F.greatest(F.coalesce(likelihood, F.lit(0.0)), F.lit(1e-16))))
    right = F.avg((F.col(network.getPredictionCol()) == F.col(label)).cast("double"))
    rows, fitted, weights, done, total = [], [], None, 0, network.getMaxIter()
    while done < total:
        step = {network.maxIter: min(every, total - done)}
        if weights is not None:
            step[network.initialWeights] = weights
        stage = network.copy(step)
        model = fit_network(stage, batches)[0] if batches else stage.fit(placed_rows)
        weights, done = model.weights, done + step[network.maxIter]
        scored = model.transform(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"), right.alias("accuracy"))
        found = {r["part"]: r for r in scored.collect()}
        rows += [(done, part, r["n"], r["loss"], r["accuracy"]) for part, r in sorted(found.items())]
        fitted.append((found["validation"]["loss"] if "validation" in found else 0.0, model))
        best = min(range(len(fitted)), key=lambda i: fitted[i][0])
        if patience is not None and len(fitted) - 1 - best >= patience:
            break
    last = fitted[best if patience is not None else -1][1]
    curve = train.sparkSession.createDataFrame(rows, "iteration int, part string, n long, loss double, accuracy double")
    return PipelineModel(stages=[*prepared.stages, last]), curve


def predict(model: Transformer, test: DataFrame, key: Sequence[str], label: str = "label") -> DataFrame:
    """Key, true label and prediction of every test row."""
    return score(model, test).select(*key, F.col(label).alias("label"), "prediction")


def preview(predictions: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` predictions by key."""
    return predictions.orderBy(*key).limit(n)


def test_error(predictions: DataFrame, label: str = "label") -> float:
    evaluator = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="accuracy"
    )
    return 1.0 - evaluator.evaluate(predictions)


def model_summary(model: PipelineModel) -> DataFrame:
    """One row per fitted tree ensemble: (class, trees, nodes); one row for a network."""
    last = model.stages[-1]
    parts = last.models if isinstance(last, OneVsRestModel) else [last]
    rows = []
    for i, part in enumerate(parts):
        is_network = isinstance(part, MultilayerPerceptronClassificationModel)
        rows.append((i, type(part).__name__, 0 if is_network else part.getNumTrees,
                     part.weights.size if is_network else part.totalNumNodes))
    return SparkSession.active().createDataFrame(rows, "class int, kind string, trees int, size int")


def training_history(model: PipelineModel) -> DataFrame:
    """(iteration, objective) of the network that ends the pipeline: one fit, all its iterations."""
    noted = getattr(model, "objective", None)
    history = model.stages[-1].summary().objectiveHistory if noted is None else noted
    return SparkSession.active().createDataFrame(
        [(i, float(v)) for i, v in enumerate(history)], "iteration int, objective double"
    )


def boosting_history(model: PipelineModel, data: DataFrame, label: str = "label") -> DataFrame:
    """(class, iteration, loss) of each two-class ensemble on ``data``."""
    *before, last = model.stages
    for stage in before:
        data = stage.transform(data)
    rows = []
    for i, trees in enumerate(last.models):
        # Each two-class ensemble was trained on a label column of its own.
        part = data.withColumn(trees.getLabelCol(), (F.col(label) == i).cast("double"))
        rows += [(i, step, float(loss)) for step, loss in enumerate(trees.evaluateEachIteration(part))]
    return data.sparkSession.createDataFrame(rows, "class int, iteration int, loss double")
