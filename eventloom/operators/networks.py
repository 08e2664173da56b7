"""Spark ML's feed-forward networks, fitted by passes over stored batches.

Spark's own learner stacks every row with its label in the JVM: a window of 30 events has each event 30 times, in
memory or on disk, and is multiplied by plain Java loops in every iteration. Here the rows are stored once as
batches of numbers; windows are cut from their events when a batch is read. A pass is one Arrow task per
split that adds up loss and gradient in numpy; the driver adds up the tasks' sums, whose size is that of the network,
and takes the step of L-BFGS. Objective, first weights, line search and stopping rule are
those of Spark's learner, and the result is its model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import MinMaxScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize

#: Windows of a stored batch, and those multiplied at a time; whole numbers of stacks of any usual size.
PACK_ROWS = 4096
STEP_ROWS = 512
_BATCH = "part int, first long, data binary, starts binary, labels binary"
_SUMS = "part int, first long, stacks long, loss double, gradient binary"
#: Steps that the inverse Hessian is made from, and the rules of the line search.
_MEMORY = 10
_DECREASE, _CURVATURE, _TRIES = 1e-4, 0.9, 10
_VALUES = 20


@dataclass(frozen=True)
class Batches:
    """Stored rows of a fit. A row of the network is ``look_back`` rows of ``width`` numbers.

    It is scaled as (x - low) * scale + least, if those are given.

    ``stack`` rows share one weight in the objective, as in Spark's learner, where the last stack of a
    partition may be smaller.
    """

    table: DataFrame
    width: int
    look_back: int = 1
    stack: int = 128
    low: np.ndarray | None = None
    scale: np.ndarray | None = None
    least: np.ndarray | None = None


def checked_label(label: Column, classes: int) -> Column:
    """The label as a whole number; what is no class ends the fit."""
    known = label.isNotNull() & (label >= 0) & (label < classes) & (label == F.floor(label))
    return F.when(known, label.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no class: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def row_batches(rows: DataFrame, network: MultilayerPerceptronClassifier) -> Batches:
    """Batches of rows with a features and a label column, in their partitions and order."""
    layers = network.getLayers()
    wanted = rows.select(
        vector_to_array(network.getFeaturesCol()).alias("data"), F.array(F.lit(0)).alias("starts"),
        F.array(checked_label(F.col(network.getLabelCol()), layers[-1])).alias("labels"),
    )
    return _stored(wanted, layers[0], 1, network.getBlockSize())


def _stored(rows: DataFrame, width: int, look_back: int, stack: int, **scaling) -> Batches:
    """Stores (data, starts, labels): numbers row after row, where in them windows start, and their labels."""
    pack = -(-PACK_ROWS // stack) * stack
    table = materialize(rows.withColumn("part", F.spark_partition_id()).mapInArrow(_packer(width, look_back, pack), _BATCH), "network-batches")
    return Batches(table, width, look_back, stack, **scaling)


def window_batches(rows: DataFrame, network: MultilayerPerceptronClassifier, look_back: int, scaler: MinMaxScalerModel) -> Batches:
    """Batches of windows over (data, starts, label), which are cut and scaled when a batch is read.

    ``data`` has the rows of a sequence one after the other, ``starts`` the first row of each window in order, ``label`` their labels.
    """
    layers = network.getLayers()
    labels = F.transform("label", lambda y: checked_label(y, layers[-1]))
    low, high = scaler.originalMin.toArray(), scaler.originalMax.toArray()
    to, fixed, span = scaler.getMax() - scaler.getMin(), (scaler.getMax() + scaler.getMin()) / 2, high - low
    # A column of one value becomes the middle of the range.
    scale = np.divide(to, span, out=np.zeros(len(span)), where=span != 0)
    least = np.where(span != 0, scaler.getMin(), fixed)
    return _stored(rows.select("data", "starts", labels.alias("labels")), layers[0] // look_back, look_back, network.getBlockSize(), low=low, scale=scale, least=least)


def _packer(width: int, look_back: int, pack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(part: int, first: int, data: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        # A row that no window has may hold anything.
        if not np.isfinite(data).all() and not np.isfinite(_windows(data, width, look_back)[starts]).all():
            raise ValueError("features must be finite")
        blobs = [pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for v, kind in ((data, np.float64), (starts, np.int32), (labels, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), *blobs], names=["part", "first", "data", "starts", "labels"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = 0
        kept, waiting = [], 0

        def take(n: int) -> pa.RecordBatch:
            """The first ``n`` windows waiting, with the numbers they are cut from."""
            nonlocal kept, waiting, first
            data, starts, labels, at, left = [], [], [], 0, n
            while left:
                d, s, y = kept[0]
                some = min(left, len(s))
                # Windows are in order: only the rows from the first one's to the last one's are stored.
                used = d[s[0] * width : (s[some - 1] + look_back) * width]
                data.append(used)
                starts.append(s[:some] - s[0] + at)
                labels.append(y[:some])
                at, left = at + len(used) // width, left - some
                if some < len(s):
                    kept[0] = (d, s[some:], y[some:])
                else:
                    kept.pop(0)
            waiting -= n
            first += n
            return batch(part, first - n, np.concatenate(data), np.concatenate(starts), np.concatenate(labels))

        for rows in batches:
            if not rows.num_rows:
                continue
            part = rows.column("part")[0].as_py()
            lists = [rows.column(name) for name in ("data", "starts", "labels")]
            data, starts, labels = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            ends = [np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) for c in lists]
            # The numbers of all records of an Arrow batch are one run: starts count from its beginning.
            shift = np.repeat(ends[0][:-1] // width, np.diff(ends[1]))
            starts = starts.astype(np.int64) + shift
            per_cut = max(1, pack // 4)
            for at in range(0, rows.num_rows, per_cut):
                to = min(at + per_cut, rows.num_rows)
                w0, w1 = ends[1][at], ends[1][to]
                if w0 < w1:
                    kept.append((data[ends[0][at] : ends[0][to]], starts[w0:w1] - ends[0][at] // width, labels[w0:w1]))
                    waiting += w1 - w0
                while waiting >= pack:
                    yield take(pack)
        if waiting:
            yield take(waiting)

    return store


def _windows(data: np.ndarray, width: int, look_back: int) -> np.ndarray:
    """A view of the window that starts at each row."""
    return np.lib.stride_tricks.sliding_window_view(data, look_back * width)[::width]


def _shapes(layers: Sequence[int]) -> list[tuple[int, int, int]]:
    """(offset, inputs, outputs) of each layer's weights, which their biases follow."""
    found, at = [], 0
    for n, m in zip(layers, layers[1:]):
        found.append((at, n, m))
        at += n * m + m
    return found


class _Pass:
    """Loss and gradient of a task's batches at given weights."""

    def __init__(self, batches: Batches, layers: Sequence[int], weights: np.ndarray):
        self.width, self.look_back, self.stack = batches.width, batches.look_back, batches.stack
        self.low, self.scale, self.least = batches.low, batches.scale, batches.least
        self.layers, self.weights = list(layers), weights

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = [(self.weights[at : at + n * m].reshape(n, m), self.weights[at + n * m : at + n * m + m]) for at, n, m in _shapes(self.layers)]
        sums: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data, starts, labels = (np.frombuffer(batch.column(2 + j)[i].as_buffer(), kind) for j, kind in enumerate((np.float64, np.int32, np.int32)))
                if part not in sums:
                    sums[part] = [first, 0, 0.0, np.zeros(len(self.weights))]
                mine = sums[part]
                windows = _windows(data, self.width, self.look_back)
                # Every stack counts alike, a smaller last one too.
                full = len(starts) // self.stack * self.stack
                share = np.full(len(starts), 1 / self.stack)
                share[full:] = 1 / max(len(starts) - full, 1)
                mine[1] += -(-len(starts) // self.stack)
                for at in range(0, len(starts), STEP_ROWS):
                    rows = slice(at, at + STEP_ROWS)
                    x = windows[starts[rows]]
                    if self.low is not None:
                        x -= self.low
                        x *= self.scale
                        x += self.least
                    mine[2] += _add(x, labels[rows], share[rows], layers, mine[3])
        if sums:
            columns = [pa.array(list(sums), pa.int32()), *(pa.array([s[j] for s in sums.values()], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s[3].tobytes() for s in sums.values()], pa.binary())], names=["part", "first", "stacks", "loss", "gradient"])


def _add(x: np.ndarray, labels: np.ndarray, share: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> float:
    """Adds the rows' gradient, and returns their loss: softmax and cross entropy after sigmoid layers."""
    outputs = [x]
    for i, (w, b) in enumerate(layers):
        z = outputs[-1] @ w
        z += b
        if i < len(layers) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        outputs.append(z)
    p = outputs.pop()
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(labels)), labels
    # A likelihood of nothing is an infinite loss, which the line search turns back from.
    with np.errstate(divide="ignore"):
        loss = -float((np.log(p[own]) * share).sum())
    p[own] -= 1
    p *= share[:, None]
    at = len(gradient)
    for (w, b), a in zip(reversed(layers), reversed(outputs)):
        n, m = w.shape
        at -= n * m + m
        gradient[at : at + n * m] += (a.T @ p).reshape(-1)
        gradient[at + n * m : at + n * m + m] += p.sum(axis=0)
        if at:
            p = p @ w.T
            p *= a
            np.subtract(1, a, out=a)
            p *= a
    return loss


def objective(batches: Batches, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean loss and its gradient, a pass over the batches each time."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        # Tables stay with the driver: a task gets the rules of a pass alone.
        work = _Pass(batches, layers, weights)
        rows = sorted(batches.table.mapInArrow(work.run, _SUMS).collect(), key=lambda r: (r["part"], r["first"]))
        if not rows:
            raise ValueError("no rows to fit on")
        stacks, loss, gradient = 0, 0.0, np.zeros(len(weights))
        for r in rows:
            stacks, loss = stacks + r["stacks"], loss + r["loss"]
            gradient += np.frombuffer(r["gradient"])
        return loss / stacks, gradient / stacks

    return at


def fit_network(network: MultilayerPerceptronClassifier, batches: Batches) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """The model with the configured number of iterations, and the objective before the first and after each one."""
    layers = network.getLayers()
    spark = batches.table.sparkSession
    # No row is learnt from in no iteration: Spark's learner makes its first weights, and a model of given ones.
    one = spark.createDataFrame([(0.0, Vectors.dense([0.0] * layers[0]))], [network.getLabelCol(), network.getFeaturesCol()])
    made = lambda given: network.copy({network.maxIter: 0, **given}).fit(one)
    first = network.getInitialWeights() if network.isSet(network.initialWeights) else made({}).weights
    weights, values = minimize(objective(batches, layers), np.asarray(first.toArray(), np.float64), network.getMaxIter(), network.getTol())
    model = made({network.initialWeights: Vectors.dense(weights)})
    model.set(model.maxIter, network.getMaxIter())
    return model, values


# L-BFGS as Spark's learners have it


class _Failed(Exception):
    """A search for a step that found none."""


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """The last point, and the value at the first one and after every iteration.

    Ends after ``iterations``, when the value has not fallen by ``tolerance`` of the first one in so many steps,
    where the gradient is flat, or where no step is found from a fresh start either.
    """
    value, gradient = f(x)
    first, values = value, [value]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    recent, done, failed = [np.inf], 0, False
    while True:
        if done >= iterations or np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        if len(recent) >= 2 and abs(value - max(recent)) <= tolerance * first:
            break
        try:
            direction = _direction(steps, gradient)
            length, point, new, slope = _search(f, x, value, gradient, direction, 1 / np.linalg.norm(direction) if done == 0 else 1.0)
        except _Failed:
            values.append(value)
            if failed:
                break
            steps, failed = [], True
            continue
        steps = [(point - x, slope - gradient), *steps][:_MEMORY]
        x, value, gradient = point, new, slope
        recent, done, failed = [*recent, value][-_VALUES:], done + 1, False
        values.append(value)
    return x, values


def _direction(steps: Sequence[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> np.ndarray:
    """The gradient times the inverse Hessian that the last steps give, downwards."""
    found, shares = gradient.copy(), []
    scale = 1.0
    if steps:
        s, y = steps[0]
        if not s @ y >= 0:
            raise _Failed
        scale = (s @ y) / (y @ y)
    for s, y in steps:
        shares.append((s @ found) / (s @ y))
        if np.isnan(shares[-1]):
            raise _Failed
        found -= shares[-1] * y
    found *= scale
    for (s, y), share in zip(reversed(steps), reversed(shares)):
        found += (share - (y @ found) / (s @ y)) * s
    return -found


def _search(f: Callable, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, t: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """A step that meets the strong Wolfe conditions: (length, point, value, gradient)."""
    slope = gradient @ direction
    if slope > 0:
        raise _Failed

    def phi(t: float) -> tuple[float, float, float, np.ndarray, np.ndarray]:
        point = x + direction * t
        new, at = f(point)
        return t, new, at @ direction, point, at

    def taken(c: tuple) -> tuple[float, np.ndarray, float, np.ndarray]:
        if c[0] * np.linalg.norm(gradient) < 1e-10:
            raise _Failed
        return c[0], c[3], c[1], c[4]

    def zoom(low: tuple, high: tuple) -> tuple[float, np.ndarray, float, np.ndarray]:
        for _ in range(_TRIES):
            c = phi(_between(*sorted((low, high), key=lambda b: b[0])))
            if c[1] > value + _DECREASE * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= _CURVATURE * abs(slope):
                    return taken(c)
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    low = (0.0, value, slope, x, gradient)
    for i in range(_TRIES):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + _DECREASE * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= _CURVATURE * abs(slope):
            return taken(c)
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def _between(left: tuple, right: tuple) -> float:
    """Where a cubic through both ends has its least value, not too close to either."""
    (lt, lv, ls), (rt, rv, rs) = left[:3], right[:3]
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    with np.errstate(invalid="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - ls * rs))
    t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(low if t < low else high if t > high else t)
