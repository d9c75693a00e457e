"""Keyed writes and table differences (K-01 to K-08, U-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """Hash of a row's columns but volatile ones."""
    return F.xxhash64(*[c for c in df.columns if c not in without])


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows whose key it doesn't hold yet; of new rows with one key the first by hash."""
    fresh = rows.join(table.select(*key), key, "left_anti").dropDuplicates(key)
    return table.unionByName(fresh)


def insert_or_replace(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows put in place of those with their keys."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def upsert_keeping(table: DataFrame, rows: DataFrame, key: list[str], kept: tuple[str, ...]) -> DataFrame:
    """New rows win, but in `kept` columns what the table holds stays (K-03, K-04)."""
    rest = [c for c in table.columns if c not in key]
    met = table.select(*key, F.struct(*rest).alias("o")).join(rows.select(*key, F.struct(*rest).alias("n")), key, "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in kept else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return met.select(*key, *[pick(c).alias(c) for c in rest])


def table_diff(remote: DataFrame, local: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(side, hash, n): rows to delete from the remote table and to insert, as multisets of row hashes.

    One pass of partial counts over both tables; repeated rows count as often as they differ."""
    one = lambda df, sign: df.select(row_hash(df, volatile).alias("hash"), F.lit(sign).alias("d"))
    net = one(local, 1).unionByName(one(remote, -1)).groupBy("hash").agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select(F.when(F.col("d") > 0, "insert").otherwise("delete").alias("side"), "hash", F.abs("d").alias("n"))


def sync_plan(remote: DataFrame, local: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """One row: deletes, inserts and whether a rebuild is cheaper (more than half of the rows differ, or the schema does)."""
    if [(f.name, f.dataType) for f in remote.schema] != [(f.name, f.dataType) for f in local.schema]:
        return local.agg(F.lit(0).cast("long").alias("deletes"), F.count("*").alias("inserts"), F.lit(True).alias("rebuild"))
    diff = table_diff(remote, local, volatile).agg(F.sum(F.when(F.col("side") == "delete", F.col("n"))).alias("d"), F.sum(F.when(F.col("side") == "insert", F.col("n"))).alias("i"))
    sized = diff.withColumn("k", F.lit(1)).join(local.agg(F.count("*").alias("rows")).withColumn("k", F.lit(1)), "k")
    return sized.select(F.coalesce("d", F.lit(0)).alias("deletes"), F.coalesce("i", F.lit(0)).alias("inserts"), (F.coalesce("i", F.lit(0)) * 2 > F.col("rows")).alias("rebuild"))
