"""Where intermediate tables live, and when they go.

Jobs that need the same intermediate result twice write it to the shared folder named by
``spark.checkpoint.dir`` and read it back: the lineage is cut, and a lost executor costs a
re-read instead of a recomputation. Tables made inside ``scratch_tables`` are deleted when the
block ends; results that read them must be used up or stored before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Partitions of a table that models are fitted on, whatever the cluster.
FIT_PARTITIONS = 32

_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for an unconfigured local session."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def cut_lineage(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage in the shared folder, too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/eventloom/{name}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the paths handed out in this block when it ends, failed or not."""
    token = _owned.set([])
    try:
        yield
    finally:
        paths = _owned.get() or []
        _owned.reset(token)
        for path in paths:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``scratch_path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs in this block goes to Python in batches of ``most`` bytes, unless the session has smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if int(before.rstrip("b")) > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """The rows by hash of their unique key, in its order within ``partitions`` partitions.

    Learners draw samples by partition and row: placed alike, a table gives the same model on
    any number of cores.
    """
    return df.repartition(partitions, key).sortWithinPartitions(key)
