"""Evidence in Merkle batches: leaves, roots, proofs and their check (M-01 to M-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators.ordering import row_index

#: Bytes before a leaf's payload and a node's children; leaves a batch.
LEAF, NODE, BATCH = "00", "01", 1024


def leaf_hash(payload: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit(LEAF)), F.encode(payload, "UTF-8")), 256)


def node_hash(a: Column, b: Column) -> Column:
    """Hash of two children in hex, the smaller first."""
    return F.sha2(F.concat(F.unhex(F.lit(NODE)), F.unhex(F.least(a, b)), F.unhex(F.greatest(a, b))), 256)


def level_up(level: Column) -> Column:
    """The level above: neighbours in pairs, a last odd one unchanged."""
    above = lambda i: F.when(2 * i + 1 < F.size(level), node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1), above)


def levels_of(size: int) -> int:
    return max(1, (size - 1).bit_length())


def merkle_root(leaves: Column, size: int = BATCH) -> Column:
    """Root of an array of at most `size` leaves."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels_of(size))), leaves, lambda level, _: F.when(F.size(level) > 1, level_up(level)).otherwise(level), lambda level: F.get(level, F.lit(0)))


def merkle_proof(leaves: Column, index: Column, size: int = BATCH) -> Column:
    """Siblings from a leaf up; a node without one adds none."""
    zero = F.struct(leaves.alias("level"), index.cast("int").alias("i"), F.array().cast("array<string>").alias("proof"))

    def step(a: Column, _: Column) -> Column:
        sibling = F.get(a["level"], F.when(a["i"] % 2 == 0, a["i"] + 1).otherwise(a["i"] - 1))
        proof = F.when((F.size(a["level"]) > 1) & sibling.isNotNull(), F.array_append(a["proof"], sibling)).otherwise(a["proof"])
        return F.struct(F.when(F.size(a["level"]) > 1, level_up(a["level"])).otherwise(a["level"]).alias("level"), F.floor(a["i"] / 2).cast("int").alias("i"), proof.alias("proof"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels_of(size))), zero, step, lambda a: a["proof"])


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    return F.aggregate(proof, leaf, node_hash) == root


def batches(evidence: DataFrame, order: str, payload: str, size: int = BATCH) -> DataFrame:
    """Evidence in ascending order of an integer column to batch, n, leaves, root, previous_root.

    A batch's leaves meet in one row: at most `size` hashes.  Each batch names the root before it by an equi-join, not a global window."""
    placed = row_index(evidence.select(order, payload), order)
    leaves = placed.select(F.floor(F.col("idx") / size).alias("batch"), F.struct(F.col("idx").alias("i"), leaf_hash(F.col(payload)).alias("leaf")).alias("l"))
    rooted = leaves.groupBy("batch").agg(F.sort_array(F.collect_list("l")).alias("l")).select("batch", F.size("l").alias("n"), F.col("l.leaf").alias("leaves"))
    rooted = rooted.withColumn("root", merkle_root(F.col("leaves"), size))
    before = rooted.select((F.col("batch") + 1).alias("batch"), F.col("root").alias("previous_root"))
    return rooted.join(before, "batch", "left")
