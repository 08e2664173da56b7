"""License notices in texts, by diagonal voting against templates.

All rolling k-gram hashes of a text's words meet the template positions that have the same hash.
A hit at word p of the text and word t of a template votes for the diagonal p - t; the votes of
a diagonal are joined with those of diagonals close by (words put in or left out shift the rest
of a notice), and what a merged group covers of the template decides. The phrases of ``PHRASES``
must stand whole on one diagonal; a notice must be covered to ``COVERAGE``.

The template tables are the fixed values below, so their broadcast has a fixed size. Hits are
compared word by word with the template where they are found, so equal hashes are not trusted.

A null text counts as empty; null and repeated doc_ids and further columns do no harm: rows are
told apart by a number of their own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import Words, letters_and_digits, rolling, small_batches, spans
from eventloom.session import materialize

K = 4
COVERAGE = 0.75
#: A notice of so few words often ends in a version, so its last words must be there.
SHORT = 14
#: Diagonals no further apart than this are merged.
SHIFT = 3
PIECE_BYTES = 2 << 20

# Phrases and the label of each.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Common notices, in the words of their licenses, and the label of each.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

HIT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType())])
SCANNED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT))])


@lru_cache(maxsize=1)
def template_positions() -> list[tuple[int, int, int, int, int, bool, str]]:
    """(hash, template, position, k, template length, whole phrase, label) of every k-gram."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES, *NOTICES]):
        words = Words(pa.array([text]), letters_and_digits())
        k = min(K, len(words.hashes))
        grams = rolling(words.hashes, range(k), salt=k).view(np.int64)
        rows += [(int(h), n, p, k, len(words.hashes), n < len(PHRASES), label) for p, h in enumerate(grams)]
    return rows


@lru_cache(maxsize=1)
def _grams() -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[bytes]]]]:
    """For each k: the hashes in order, a mask of their low 16 bits, and the words of each hash."""
    texts, by_k = [t.encode().split() for t, _ in [*PHRASES, *NOTICES]], {}
    for h, n, p, k, *_ in template_positions():
        by_k.setdefault(k, {})[h] = texts[n][p : p + k]
    out = {}
    for k, words in by_k.items():
        hashes = np.sort(np.array(list(words), np.int64))
        mask = np.zeros(1 << 16, bool)
        mask[hashes & 0xFFFF] = True
        out[k] = (hashes, mask, words)
    return out


def scan(texts: pa.Array) -> pa.Array:
    """Words of each text, and its k-grams that some template has."""
    counts, hits = [], []
    for low, high in spans(texts, PIECE_BYTES):
        words = Words(texts.slice(low, high - low), letters_and_digits(), lower=True)
        owner, found = words.owner(), [[] for _ in range(len(words))]
        for k, (hashes, mask, known) in _grams().items():
            grams = rolling(words.hashes, range(k), salt=k).view(np.int64)
            at = np.flatnonzero(mask[grams & 0xFFFF])
            at = at[np.isin(grams[at], hashes)]
            for p in at:
                if owner[p] == owner[p + k - 1] and [words.word(i) for i in range(p, p + k)] == known[int(grams[p])]:
                    found[owner[p]].append({"hash": int(grams[p]), "pos": int(p - words.first[owner[p]])})
        counts.append(np.diff(words.first))
        hits += found
    n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
    of_hits = pa.array(hits, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64())])))
    return pa.StructArray.from_arrays([n_words, of_hits], ["n_words", "hits"])


def _positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_positions(), "hash long, template int, t long, k int, length int, phrase boolean, label string")


def places(hits: DataFrame, positions: DataFrame) -> DataFrame:
    """Template places: (row, label, phrase, start, coverage) of each merged group of diagonals.

    hits: (row, hash, pos). A diagonal's votes are at most the template's positions.
    """
    voted = hits.join(F.broadcast(positions), "hash").withColumn("diagonal", F.col("pos") - F.col("t"))
    by_diagonal = voted.groupBy("row", "template", "diagonal").agg(
        F.collect_set("t").alias("ts"), F.min("pos").alias("start"), F.first("k").alias("k"), F.first("length").alias("length"), F.first("phrase").alias("phrase"), F.first("label").alias("label")
    )
    of_template = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of_template) > SHIFT, F.lit(True)) | F.col("phrase")
    merged = by_diagonal.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(of_template))
    merged = merged.groupBy("row", "template", "part").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("start").alias("start"), F.first("k").alias("k"), F.first("length").alias("length"), F.first("phrase").alias("phrase"), F.first("label").alias("label")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    verified = merged.withColumn("coverage", covered / F.col("length"))
    whole_end = (F.col("length") > SHORT) | F.array_contains("ts", (F.col("length") - F.col("k")).cast("long"))
    return verified.filter(whole_end & (F.col("coverage") >= F.when(F.col("phrase"), 1.0).otherwise(COVERAGE))).select("row", "label", "phrase", "start", "coverage")


def find_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: words, places of the phrases, labels and the best coverage."""
    spark = documents.sparkSession
    scanned = small_batches(documents).select("doc_id", F.arrow_udf(scan, SCANNED)(F.col(text)).alias("s")).select("doc_id", "s.*")
    stored = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "license-hits")
    found = places(stored.select("row", F.inline("hits")), _positions(spark))
    joined_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_row = found.groupBy("row").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).alias("last_word"),
        joined_labels(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined_labels(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    columns = [F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    return stored.join(by_row, "row", "left").select("doc_id", "n_words", *columns)
