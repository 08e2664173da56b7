"""Quality scores by a sparse rule ensemble over statistics of the whole text.

Shallow trees are grown on labelled rows; every path from a root to a node becomes a rule, a
conjunction of bounds on statistics. A logistic regression with an L1 penalty gives most rules
the weight 0; the others are compiled into one Spark column expression, so that scoring is
arithmetic on the statistics' columns.

The trees and weights are fitted on at most ``SAMPLE`` labelled rows, those least by a hash of
their id, sorted and in one partition: the same rows give the same model on any cluster. The
statistics are taken from every text and stored once.

A null text has the statistics of an empty one. Rows with a null id or label are scored, but not
learnt from; an id labelled twice is learnt from twice, once per label. Without rows of both
labels to learn from, every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import Words, fold_of, not_spaces, small_batches, spans
from eventloom.session import materialize

SAMPLE = 20_000
TREES, DEPTH, PENALTY = 12, 3, 0.001
FOLDS, HELD_OUT = 3, 1
PIECE_BYTES = 2 << 20

STATISTICS = [
    "log_chars", "log_words", "log_lines", "word_length", "longest_word", "upper", "digit", "space", "mark", "symbol",
    "exclamation", "bar", "beyond_ascii", "marks_in_row", "distinct_words", "repeated_lines", "words_a_line",
]


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_COUNTED = {
    "upper": _table(bytes(range(65, 91))), "digit": _table(bytes(range(48, 58))), "space": _table(b" \t\n\r\v\f"), "mark": _table(_MARKS),
    "symbol": _table(bytes(c for c in _MARKS if c not in b".,;:!?'\"()-|")), "exclamation": _table(b"!"), "bar": _table(b"|"),
}


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner."""
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text; shares are of its bytes, words or lines."""
    words = Words(texts, not_spaces())
    newline = np.ones(256, bool)
    newline[10] = False
    lines = Words(texts, newline)
    n, low, high = len(words), words.bounds[:-1], words.bounds[1:]

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[high] - sums[low]).astype(float)

    size, n_words, n_lines = (high - low).astype(float), np.diff(words.first).astype(float), np.diff(lines.first).astype(float)
    per = lambda x, of: x / np.maximum(of, 1)
    out = {name: per(total(table[words.data]), size) for name, table in _COUNTED.items()}
    out["beyond_ascii"] = per(total(words.data >= 128), size)
    marks = _COUNTED["mark"][words.data].astype(bool)
    twice = np.zeros(len(marks), bool)
    twice[1:] = marks[1:] & marks[:-1]
    out["marks_in_row"] = per(total(twice), size)
    lengths = (words.ends - words.starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, words.owner(), lengths)
    out["word_length"] = per(np.bincount(words.owner(), lengths, n), n_words)
    out["longest_word"] = np.log1p(longest)
    out["log_chars"], out["log_words"], out["log_lines"] = np.log1p(size), np.log1p(n_words), np.log1p(n_lines)
    # A longer text repeats more words: the distinct ones are measured against a root of its length.
    out["distinct_words"] = per(_distinct(words.owner(), words.hashes, n), np.maximum(n_words, 1) ** 0.8)
    out["repeated_lines"] = per(n_lines - _distinct(lines.owner(), lines.hashes, n), n_lines)
    out["words_a_line"] = np.log1p(per(n_words, n_lines))
    return out


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def statistics_of(texts: pa.Array) -> pa.Array:
    parts = [statistics(texts.slice(a, b - a)) for a, b in spans(texts, PIECE_BYTES)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[s] for p in parts]) if parts else [], pa.float64()) for s in STATISTICS], STATISTICS)


@dataclass(frozen=True)
class Rule:
    """All of the bounds (statistic, whether at most, threshold) hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        conditions = [F.col(s) <= t if at_most else F.col(s) > t for s, at_most, t in self.bounds]
        return reduce(lambda a, b: a & b, conditions)


def _paths(node, bounds: dict) -> list[Rule]:
    """The rules of all nodes below one, with one bound per statistic and direction."""
    if node.subtreeDepth() == 0:
        return []
    split, rules = node.split(), []
    for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
        own = {**bounds, (STATISTICS[split.featureIndex()], at_most): split.threshold()}
        rules += [Rule(tuple(sorted((s, m, t) for (s, m), t in own.items()))), *_paths(child, own)]
    return rules


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as one expression over the statistics."""
        margin = reduce(lambda total, rule: total + F.when(rule[0].column(), rule[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def fit(labelled: DataFrame) -> RuleEnsemble:
    """labelled: the statistics, and label (0.0 or 1.0); a bounded sample in one partition."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return RuleEnsemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    vectors = labelled.select("label", *STATISTICS, array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=7).fit(vectors)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), {})))
    if not rules:
        share = counts[1.0] / sum(counts.values())
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    held = vectors.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=100).fit(held)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0))


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fits on rows outside the held-out fold. measured: doc_id and the statistics."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "label").limit(sample)
    rows = measured.join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id", "label", *STATISTICS).limit(sample)
    return fit(materialize(rows.select("label", *STATISTICS).coalesce(1), "quality-sample"))


def score_documents(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns in ``keep``, as a struct ``kept``), held_out, score and predicted."""
    kept = [F.struct(*keep).alias("kept")] if keep else []
    measured = materialize(small_batches(documents).select("doc_id", *kept, statistics_of("text").alias("s")).select("doc_id", *(["kept"] if keep else []), "s.*"), "text-statistics")
    model = learn(measured.select("doc_id", *STATISTICS), labels)
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = measured.select("doc_id", *(["kept"] if keep else []), held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are predicted to have label 1."""
    model = learn(materialize(small_batches(documents).select("doc_id", statistics_of("text").alias("s")).select("doc_id", "s.*"), "text-statistics"), labels)
    packed = documents.select(F.struct("*").alias("doc"), statistics_of("text").alias("s")).select("doc", "s.*")
    return packed.filter(model.score() >= 0.5).select("doc.*")
