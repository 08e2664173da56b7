import math
import re
from zlib import crc32

import pyarrow as pa
import pytest

from eventloom.llm import quality as Q
from eventloom.llm.text import read_table
from tests.llm.helpers import documents


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_statistics_equal_plain_python():
    texts = ["Ab! 1|2\nAb! x\nAb! 1|2", "", None, "é é", "###"]
    got = Q.statistics(pa.array(texts))
    for i, t in enumerate(t or "" for t in texts):
        data, words, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
        assert got["upper"][i] == sum(65 <= c <= 90 for c in data) / max(1, len(data))
        assert got["marks_in_row"][i] == len(re.findall(r"(?<=[!-/:-@\[-`{-~])[!-/:-@\[-`{-~]", t)) / max(1, len(data))
        assert got["distinct_words"][i] == pytest.approx(len(set(words)) / max(1, len(words)) ** 0.8)
        assert got["repeated_lines"][i] == (len(lines) - len(set(lines))) / max(1, len(lines))
        assert got["log_words"][i] == math.log1p(len(words))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    rows = Q.score_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")).collect()
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    recall = {k: sum(p == q for p, _, q in held if q == k) / sum(q == k for *_, q in held) for k in (0, 1)}
    assert recall[1] > 0.99 and recall[0] > 0.9, recall


def test_compiled_rules_equal_the_conjunctions(spark, sf):
    measured = read_table(spark, sf, "documents").select("doc_id", Q.statistics_of("text").alias("s")).select("doc_id", "s.*")
    model = Q.learn(measured, read_table(spark, sf, "labels"))
    assert 0 < len(model.rules) < 150
    for row in measured.withColumn("score", model.score()).limit(50).collect():
        margin = model.intercept + sum(w for rule, w in model.rules if all((row[s] <= t) == m for s, m, t in rule.bounds))
        assert row.score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_same_rows_give_the_same_model(spark, sf):
    measured = read_table(spark, sf, "documents").select("doc_id", Q.statistics_of("text").alias("s")).select("doc_id", "s.*")
    known = read_table(spark, sf, "labels")
    assert Q.learn(measured.repartition(2), known) == Q.learn(measured.repartition(7), known.repartition(3))


def test_odd_rows(spark):
    docs = documents(spark, [(1, "GOOD words here"), (1, None), (None, "x"), (2, ""), (3, "a" * 100_000)], extra=("score", "label", "kept"))
    for known in ([], [(1, 1, 0, "")], [(1, None, None, ""), (None, 1, 0, ""), (2, 0, 0, ""), (2, 0, 0, ""), (3, 1, 1, "")]):
        rows = Q.score_documents(docs, labels(spark, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert Q.score_documents(documents(spark, []), labels(spark, [])).count() == 0
    kept = Q.accepted(docs, labels(spark, [(1, 1, 0, "")]))
    assert kept.columns == docs.columns
