"""Shared storage for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it.

    Where it is unset, a local Spark gets a temporary folder; a cluster gets an error, as its machines would each write to a disk of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_casebook_shared_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="casebook-")
        spark._casebook_shared_dir = made
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind.  A Spark that doesn't know the setting keeps them longer."""
    if not spark.conf.isModifiable(_CLEANUP):
        yield
        return
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Spark's bound on the bytes of one batch of rows that goes to a Python worker, 64 MB if nobody sets it.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int) -> None:
    """From now on this session sends Python workers batches of at most `most` bytes, or of one row.  A smaller bound that is set already stays.

    It holds for what a caller runs later, too: a plan that a function returns is cut into batches by the session's settings when it runs.  A Spark that doesn't
    know the setting keeps its batches."""
    if not spark.conf.isModifiable(_BATCH):
        return
    found = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < found <= most:
        spark.conf.set(_BATCH, most)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to shared storage and read again: lineage ends here, a lost executor costs nothing."""
    return materialize_all([df], name)


def materialize_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Writes one part after the other, so that what shuffles them takes the disk of one part; reads all as one table.  At least one part."""
    path = schema = None
    for df in parts:
        path = path or fresh_path(df.sparkSession, name)
        spark, schema = df.sparkSession, df.schema
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found._written = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these tables, once nothing will read them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
