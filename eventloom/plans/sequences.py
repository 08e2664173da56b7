"""Encoded events to stored look-back windows of one actor or of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from eventloom.operators.cleaning import filter_actor, keep_valid_classes
from eventloom.operators.windows import STORE_ROWS, lag_windows, sequence_blocks
from eventloom.schemas import LOOK_BACK, MODEL_COLUMNS
from eventloom.sources.readers import read_sequences
from eventloom.sources.writers import write_sequences


def actor_sequences(
    encoded: DataFrame,
    order: Sequence[str],
    actor: int | None = None,
    look_back: int = LOOK_BACK,
    features: Sequence[str] = MODEL_COLUMNS,
) -> DataFrame:
    """Windows over the valid events, by source actor; the label is also a lagged feature."""
    events = keep_valid_classes(encoded)
    if actor is not None:
        events = filter_actor(events, actor)
    return lag_windows(events, ["Source"], order, features, look_back=look_back)


def store_sequences(
    encoded: DataFrame, path: str, order: Sequence[str], actor: int | None = None
) -> DataFrame:
    """Write the windows once and return a scan of them."""
    write_sequences(actor_sequences(encoded, order, actor), path)
    return read_sequences(encoded.sparkSession, path)


def store_sequence_blocks(
    encoded: DataFrame,
    path: str,
    order: Sequence[str],
    actor: int | None = None,
    look_back: int = LOOK_BACK,
    features: Sequence[str] = MODEL_COLUMNS,
    block_rows: int = STORE_ROWS,
) -> DataFrame:
    """Write the sequences of the valid events as blocks, about the size of the events, and return a scan of them.

    ``block_windows`` cuts the windows that ``actor_sequences`` would give.
    """
    events = keep_valid_classes(encoded)
    if actor is not None:
        events = filter_actor(events, actor)
    write_sequences(sequence_blocks(events, ["Source"], order, features, look_back=look_back, block_rows=block_rows), path)
    return read_sequences(encoded.sparkSession, path)
