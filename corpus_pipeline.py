"""A training-data pipeline: documents in, token ids of clean and distinct documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Rows with a null doc_id or text, with an id or a text that others have too, and columns of any further name pass
every stage: a stage tells rows apart by their content or by a number of its own. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe_codec, decontamination, minhash, quality, secrets
from eventloom.llm.text import read_table
from eventloom.session import materialize


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rule ensemble rejects go.

    A null text is scored as an empty one; rows with a null doc_id are scored and never learnt from.
    """
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group stays (five-word shingles, similarity 0.8).

    Of equal rows one stays; documents without words are in no group and all stay.
    """
    return minhash.deduplicated(docs, k=5, threshold=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a benchmark passage go; null and empty texts hold none."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents stay, their secrets are masked and n_chars follows the text; a null text stays null."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of every document, and whether decoding them gives the text again.

    A null text has no ids.
    """
    return bpe_codec.encoded_documents(docs)


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Models, signatures and tokenizers are beyond SQL; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
