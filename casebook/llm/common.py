"""Helpers that the operators of this folder share: tables, shared storage, range buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.storage import bound_batches, discard, fresh_path, materialize  # noqa: F401

#: Longest slice of text, in bytes, that a Python task holds in numpy arrays at once.
SLICE_BYTES = 4_000_000

#: The word of every text contract: a run of anything but space, tab, newline, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Id lists of at most so many rows (some 16 MB) are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000


def rows_with(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is in a written list of ids.  The list's size decides whether the rows must be shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def release() -> None:
    """Gives freed memory back to the system at a task's end: Python workers live on and would keep it."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Bytes of text that a range of a key should hold, and that a task should.
RANGE_BYTES, TASK_BYTES = 32_000_000, 128_000_000


def text_ranges(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(ranges, tasks) for shuffling whole texts in order of a key: they grow with the bytes of the texts, counted in one scan."""
    least = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4 * least, size // RANGE_BYTES), max(1, size // TASK_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def range_buckets(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending cut points of an integer key, at most buckets - 1 of them, from a scan of the key alone."""
    if buckets < 2:
        return []
    cuts = df.select(key).na.drop().approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return sorted({int(x) for x in cuts})


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are <= key, so buckets ascend with the key; a null key belongs to bucket 0.

    The cuts travel with the function, as one sorted array, so the plan is the same for ten ranges and for a million."""
    if not cuts:
        return F.lit(0)
    table = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(table, np.asarray(keys.fill_null(0)), side="right").astype(np.int32)
        return pa.array(np.where(np.asarray(keys.is_null()), 0, found), pa.int32())

    return bucket(key.cast("long"))
