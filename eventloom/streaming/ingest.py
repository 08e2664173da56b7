"""Chunked ingest: raw files arrive, encoded rows are appended.

The chunk is a micro-batch of whole files. Its encoding is that of the batch job. An actor that
no dictionary has yet gets the next code when its first chunk arrives, so codes once given stay
and null means a missing actor only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.encoding import Dictionary, apply_dictionaries, encode_fields
from eventloom.operators.lookup import fits_broadcast
from eventloom.operators.ordering import number_rows
from eventloom.schemas import ENCODED
from eventloom.sources.readers import raw_options, raw_schema, without_missing
from eventloom.sources.writers import write_encoded

CHUNK, SNAPSHOT = "chunk", "snapshot"
# Chunks after which the codes added so far are written together.
COMPACT_CHUNKS = 10


def read_event_chunks(spark: SparkSession, path: str, files_per_chunk: int = 1000) -> DataFrame:
    return without_missing(
        spark.readStream.schema(raw_schema())
        .options(**raw_options())
        .option("maxFilesPerTrigger", files_per_chunk)
        .csv(path)
    )


def ingest_chunks(
    spark: SparkSession,
    raw_path: str,
    out_path: str,
    checkpoint: str,
    dictionaries: Sequence[Dictionary],
    files_per_chunk: int = 1000,
) -> StreamingQuery:
    """Encode all files not yet ingested, chunk by chunk, then stop.

    The checkpoint folder records what is done, and keeps the codes that chunks added. Each
    chunk writes below a folder with its number, and writes all of it anew if it is repeated
    after a failure, so no row comes twice. Within a chunk, rows are gathered by month.
    """

    def append(chunk: DataFrame, number: int) -> None:
        encoded = apply_dictionaries(
            encode_fields(chunk), [_extended(d, chunk, number, f"{checkpoint}/codes/{d.column}") for d in dictionaries]
        )
        write_encoded(encoded, f"{out_path}/{CHUNK}={number}", mode="overwrite")

    return (
        read_event_chunks(spark, raw_path, files_per_chunk)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Scan the encoded rows of all chunks."""
    return spark.read.schema(ENCODED).parquet(path).select(*ENCODED.names)


def added_codes(spark: SparkSession, dictionary: Dictionary, path: str, before: int) -> DataFrame:
    """(value, code) that chunks before a number added to a dictionary.

    The log of a dictionary is a folder of new codes per chunk and, now and then, a snapshot of all
    codes so far: read are the last snapshot and the chunks after it. Only a folder that
    is not there has no codes; one that cannot be read is an error.
    """
    schema = dictionary.table.select("value", "code").schema
    folders = _log_folders(spark, path, before)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _log_folders(spark: SparkSession, path: str, before: int) -> list[str]:
    """The folders that together have the codes of all chunks below a number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [(entry.getPath().getName(), entry.getPath()) for entry in files.listStatus(at)]
    number = lambda kind, name: int(name.removeprefix(f"{kind}=")) if name.startswith(f"{kind}=") else None
    done = [(n, p) for name, p in found if (n := number(SNAPSHOT, name)) is not None and n <= before and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    last, folders = max(((n, [p.toString()]) for n, p in done), default=(0, []), key=lambda x: x[0])
    return folders + [p.toString() for name, p in sorted(found, key=lambda x: x[0]) if (n := number(CHUNK, name)) is not None and last <= n < before]


def _compacted(spark: SparkSession, dictionary: Dictionary, path: str, number: int) -> None:
    """Writes a snapshot of the codes of all chunks before a number, unless one is done."""
    folders = _log_folders(spark, path, number)
    if folders and not folders[0].endswith(f"{SNAPSHOT}={number}"):
        schema = dictionary.table.select("value", "code").schema
        spark.read.schema(schema).parquet(*folders).write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}={number}")


def _extended(dictionary: Dictionary, chunk: DataFrame, number: int, path: str) -> Dictionary:
    """The dictionary with the codes of earlier chunks and of this one, which are stored."""
    spark = chunk.sparkSession
    if number and number % COMPACT_CHUNKS == 0:
        _compacted(spark, dictionary, path, number)
    known = dictionary.table.select("value", "code").union(added_codes(spark, dictionary, path, number))
    values = chunk.select(F.col(dictionary.column).alias("value")).distinct()
    new = values.join(known, values["value"].eqNullSafe(known["value"]), "left_anti")
    last = known.agg(F.coalesce(F.max("code"), F.lit(-1))).first()[0]
    numbered = number_rows(new.withColumn("missing", F.col("value").isNull()), [], ["missing", "value"], "seq")
    codes = numbered.select("value", (F.col("seq") + last + 1).cast("int").alias("code"))
    codes.write.mode("overwrite").parquet(f"{path}/{CHUNK}={number}")
    stored = known.union(spark.read.schema(codes.schema).parquet(f"{path}/{CHUNK}={number}"))
    return Dictionary(dictionary.column, stored, dictionary.broadcast and fits_broadcast(stored))
