"""Column selection and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.schemas import LABEL, LEAKY, MAX_CLASS, MODEL_COLUMNS


def drop_leaky(df: DataFrame, columns: Sequence[str] = LEAKY) -> DataFrame:
    """Drop the columns that give the label away; absent ones are ignored."""
    return df.drop(*columns)


def feature_columns(df: DataFrame, label: str = LABEL, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the label and ``exclude``, in table order."""
    return [c for c in df.columns if c != label and c not in exclude]


def model_columns(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The twelve modelling columns, after any key columns."""
    return df.select(*key, *MODEL_COLUMNS)


def keep_valid_classes(df: DataFrame, label: str = LABEL, max_class: int = MAX_CLASS) -> DataFrame:
    """Drop rows whose class lies above the modelled ones; class 0 stays."""
    return df.where(F.col(label) <= max_class)


def filter_actor(df: DataFrame, actor: Column | str | int, column: str = "Source") -> DataFrame:
    """Rows of one actor, by name in raw events and by number in encoded ones."""
    return df.where(F.col(column) == actor if isinstance(actor, Column) else F.col(column) == F.lit(actor))


def append_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """All rows of all chunks, columns matched by name."""
    return reduce(lambda left, right: left.unionByName(right), chunks)
