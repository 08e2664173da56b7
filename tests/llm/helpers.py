"""Small fixtures for the operators, with the odd rows every one of them must take."""

import hashlib

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, rows, extra=()):
    """rows: (doc_id, text); extra: names of more text columns."""
    kind = T.StructType([*DOCUMENTS.fields, *(T.StructField(c, T.StringType()) for c in extra)])
    filled = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows]
    return spark.createDataFrame(filled, kind)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)
