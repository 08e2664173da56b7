"""Raw files to the encoded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.operators.cleaning import drop_leaky, keep_valid_classes
from eventloom.operators.encoding import Dictionary, encode_events, fit_dictionaries
from eventloom.schemas import MODEL_COLUMNS
from eventloom.sources.readers import read_encoded, read_events, with_file_order
from eventloom.sources.writers import write_encoded


def build_encoded_table(
    spark: SparkSession, raw_path: str | list[str], out_path: str, file_order: bool = False
) -> list[Dictionary]:
    """Encode raw files into a table by year and month; returns the actor dictionaries.

    The raw files are parsed twice: for the actors' names, and to encode the rows. With
    ``file_order`` the table also keeps where each row stood in its file.
    """
    events = read_events(spark, raw_path)
    dictionaries = fit_dictionaries(events)
    if file_order:
        events = with_file_order(events)
    write_encoded(encode_events(events, dictionaries), out_path)
    return dictionaries


def load_model_table(spark: SparkSession, path: str) -> DataFrame:
    """The modelling columns of the valid classes; columns and filter reach the scan."""
    return drop_leaky(keep_valid_classes(read_encoded(spark, path, MODEL_COLUMNS)))
