"""Near-duplicate embeddings of one label, by an epsilon grid order join.

Cosine >= t of two vectors is a Euclidean distance <= epsilon = sqrt(2 - 2t) of their unit
vectors. These are projected on their leading principal axes, laid in grid cells of side epsilon
and sorted by label and cell. The sorted sequence is cut into blocks. Projection shortens
distances, so blocks whose bounding boxes are further apart than epsilon hold no pair. Blocks
whose cells on the first two axes touch meet in a join; two blocks that meet are joined by
halving both intervals again and again, skipping halves with distant boxes, down to intervals
whose cosines are computed in double precision.

Equal vectors of a label are one class with a count. A pair of blocks gives each vector's number
of links, and the links of a spanning forest: enough for components, and never more than the
vectors of the blocks. Axes come from all vectors and only decide what can be skipped.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label,
link with nothing and are kept; so do vectors of different lengths with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.components import components
from eventloom.session import materialize

AXES = 8
BLOCK = 2048
LEAF = 128
#: Added to distances that decide what is skipped, for rounding.
SLACK = 1e-7

_BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()), T.StructField("label", T.StringType()), T.StructField("size", T.IntegerType()),
        T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("nodes", T.BinaryType()), T.StructField("copies", T.BinaryType()), T.StructField("vectors", T.BinaryType()),
    ]
)
_JOINED = T.StructType(
    [
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType())]))),
        T.StructField("forest", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
    ]
)


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, key), key null where nothing can link; and the classes of equal vectors."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Adding zero makes -0.0 and 0.0 one value.
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"))
    usable = F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    key = F.when(usable, F.sha2(F.to_json(F.struct("label", "vector")), 256))
    keyed = rows.withColumn("key", key).withColumn("row", F.monotonically_increasing_id())
    stored = materialize(keyed, "embedding-rows")
    first = [F.min("row").alias("node"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")]
    classes = stored.filter("key is not null").groupBy("key").agg(*first)
    return stored.select("vec_id", "key"), materialize(classes, "embedding-classes")


def _axes(classes: DataFrame) -> np.ndarray:
    """Leading principal axes (columns) of the unit vectors, shorter vectors filled with zeros."""
    size = classes.agg(F.max(F.size("vector")).alias("d"), F.count("*").alias("n")).first()
    if not size.n:
        return np.zeros((0, AXES))
    d, k = size.d, min(AXES, size.d)
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / largest)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x))
    filled = F.concat("unit", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("unit")))
    units = classes.select(scaled.alias("scaled")).select(F.transform("scaled", lambda x: x / norm).alias("unit")).select(array_to_vector(filled).alias("unit"))
    if size.n < 2:
        return np.eye(d, k)
    return PCA(k=k, inputCol="unit", outputCol="axes").fit(units).pc.toArray()


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _blocks(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """The vectors in epsilon grid order, in blocks of one label and one length each."""
    k, bound = axes.shape[1], axes

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = v.values.to_numpy(zero_copy_only=False)
            out.append(_unit(x[None, :])[0] @ bound[: len(x)])
        return pa.array(out, pa.list_(pa.float64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, held = TaskContext.get().partitionId() << 32, 0, []

        def block(rows: list[dict]) -> dict:
            nonlocal n
            n += 1
            places = np.array([r["place"] for r in rows])
            return {
                "block": base + n, "label": rows[0]["label"], "size": len(rows), "low": places.min(axis=0).tolist(), "high": places.max(axis=0).tolist(),
                "nodes": np.array([r["node"] for r in rows], "<i8").tobytes(), "copies": np.array([r["copies"] for r in rows], "<i8").tobytes(),
                "vectors": np.array([r["vector"] for r in rows], "<f8").tobytes(),
            }

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block(rows)], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == BLOCK or (row["label"], len(row["vector"])) != (held[0]["label"], len(held[0]["vector"]))):
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    schema = pa.schema(
        [
            ("block", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
            ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()),
        ]
    )
    placed = classes.select("node", "copies", "label", "vector", F.size("vector").alias("d"), project("vector").alias("place"))
    placed = placed.withColumn("cell", F.transform("place", lambda x: F.floor(x / epsilon).cast("int")))
    order = ["label", "d", *(F.col("cell")[i] for i in range(k)), "node"]
    n = classes.agg(F.count("*").alias("n")).first().n
    spread = placed.repartitionByRange(max(1, math.ceil(n / (4 * BLOCK))), *order).sortWithinPartitions(*order)
    # Batches come in the order of the partition.
    return materialize(spread.select("node", "copies", "label", "vector", "place").mapInArrow(cut, _BLOCKS), "embedding-blocks")


def _meeting(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks (a <= b) of a label whose boxes are within epsilon."""
    cell = lambda side, i: F.floor(F.coalesce(F.col(side)[i], F.lit(0.0)) / epsilon)
    lean = blocks.select("block", "label", "low", "high")
    own = lean
    for i in range(2):
        own = own.withColumn(f"c{i}", F.explode(F.sequence(cell("low", i), cell("high", i))))
    near = own
    for i in range(2):
        near = near.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"c{i}") - 1, F.col(f"c{i}") + 1)))
    near = near.distinct()
    a, b = own.alias("a"), near.alias("b")
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.c0") == F.col("b.c0")) & (F.col("a.c1") == F.col("b.c1")) & (F.col("a.block") <= F.col("b.block"))
    gap = F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    met = a.join(b, same).filter(distance <= epsilon + SLACK).select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))
    return materialize(met.distinct(), "meeting-blocks")


class _Interval:
    """A stretch of the sequence: its vectors and the box of their projections."""

    def __init__(self, start: int, vectors: np.ndarray, norms: np.ndarray, places: np.ndarray):
        self.start, self.vectors, self.norms, self.places = start, vectors, norms, places
        self.low, self.high = places.min(axis=0), places.max(axis=0)
        self._halves = None

    def halves(self) -> list[_Interval]:
        if self._halves is None:
            m = len(self.vectors) // 2
            self._halves = [_Interval(self.start + s.start, self.vectors[s], self.norms[s], self.places[s]) for s in (slice(0, m), slice(m, len(self.vectors)))]
        return self._halves

    def apart(self, other: _Interval, epsilon: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(np.sqrt(gap @ gap)) > epsilon + SLACK


def _join(a: _Interval, b: _Interval, epsilon: float, found, same: bool) -> None:
    """Calls found(rows of a, rows of b, of cosines) for the leaves that can hold pairs."""
    if a.apart(b, epsilon):
        return
    if len(a.vectors) <= LEAF and len(b.vectors) <= LEAF:
        found(a, b, same)
        return
    left = a.halves() if len(a.vectors) > LEAF else [a]
    right = left if same else b.halves() if len(b.vectors) > LEAF else [b]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if not same or i <= j:
                _join(x, y, epsilon, found, same and i == j)


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


def _links(left: dict, right: dict | None, threshold: float, axes: np.ndarray) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links by node and a spanning forest of two blocks, or of one with itself."""
    epsilon = math.sqrt(2 - 2 * threshold)

    def interval(block: dict, start: int) -> _Interval:
        vectors = np.frombuffer(block["vectors"], "<f8").reshape(block["size"], -1)
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return _Interval(start, scaled, np.linalg.norm(scaled, axis=1), _unit(vectors) @ axes[: vectors.shape[1]])

    sides = [left] if right is None else [left, right]
    nodes = np.concatenate([np.frombuffer(s["nodes"], "<i8") for s in sides])
    copies = np.concatenate([np.frombuffer(s["copies"], "<i8") for s in sides])
    counts, forest, kept = np.zeros(len(nodes), np.int64), _Forest(len(nodes)), []

    def found(a: _Interval, b: _Interval, same: bool) -> None:
        cosines = (a.vectors @ b.vectors.T) / (a.norms[:, None] * b.norms[None, :])
        for x, y in zip(*np.nonzero(np.abs(cosines - threshold) < 1e-12)):  # too close for sums in any order
            dot = math.fsum(map(float, a.vectors[x] * b.vectors[y]))
            norms = math.sqrt(math.fsum(map(float, a.vectors[x] ** 2))) * math.sqrt(math.fsum(map(float, b.vectors[y] ** 2)))
            cosines[x, y] = dot / norms
        hit = cosines >= threshold
        if same:
            hit = np.triu(hit, 1)
        xs, ys = np.nonzero(hit)
        np.add.at(counts, xs + a.start, copies[ys + b.start])
        np.add.at(counts, ys + b.start, copies[xs + a.start])
        for x, y in zip((xs + a.start).tolist(), (ys + b.start).tolist()):
            if forest.join(x, y):
                kept.append((int(nodes[x]), int(nodes[y])))

    one = interval(left, 0)
    if right is None:
        _join(one, one, epsilon, found, True)
    elif len(left["vectors"]) // left["size"] == len(right["vectors"]) // right["size"]:
        _join(one, interval(right, left["size"]), epsilon, found, False)
    at = np.flatnonzero(counts)
    return dict(zip(nodes[at].tolist(), counts[at].tolist())), kept


def near_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, classes = _classes(embeddings)
    axes = _axes(classes)
    epsilon = math.sqrt(2 - 2 * threshold)
    blocks = _blocks(classes, axes, epsilon)
    pairs = _meeting(blocks, epsilon)

    @F.arrow_udf(_JOINED)
    def join_blocks(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):  # one pair of blocks at a time
            counts, forest = _links(a.as_py(), b.as_py() if b.is_valid else None, threshold, axes)
            out.append({"links": [{"node": k, "n": v} for k, v in counts.items()], "forest": [{"a": x, "b": y} for x, y in forest]})
        long = pa.int64()
        return pa.array(out, pa.struct([("links", pa.list_(pa.struct([("node", long), ("n", long)]))), ("forest", pa.list_(pa.struct([("a", long), ("b", long)])))]))

    whole = F.struct("size", "nodes", "copies", "vectors")
    of_a = blocks.select(F.col("block").alias("a"), whole.alias("left"))
    of_b = blocks.select(F.col("block").alias("b"), whole.alias("right"))
    with_other = pairs.filter("a != b").join(of_b, "b").select("a", "b", "right")
    alone = pairs.filter("a = b").select("a", "b", F.lit(None).cast(of_b.schema["right"].dataType).alias("right"))
    joined = with_other.union(alone).join(of_a, "a").select(join_blocks("left", "right").alias("j")).select("j.*")
    joined = materialize(joined, "embedding-links")
    links = joined.select(F.inline("links")).groupBy("node").agg(F.sum("n").alias("n"))
    found = components(joined.select(F.inline("forest")))

    of_class = classes.select("key", "node", "copies", "least_id").join(links, "node", "left").join(found, "node", "left")
    of_class = materialize(of_class.withColumn("component", F.coalesce("component", "node")), "embedding-components")
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    n_links = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    of_key = materialize(of_class.join(materialize(least, "component-ids"), "component").select("key", n_links, "component_id"), "embedding-keys")
    all_rows = rows.join(of_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return all_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
