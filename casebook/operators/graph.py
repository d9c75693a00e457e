"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.storage import discard, materialize

#: Rounds after which the input can't be a graph: each at least halves the longest path.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that edges reach from each node that has an edge.

    Loops and edges with a null end are ignored; direction and repeats don't matter.  Each round hangs all
    neighbours of a node on the smallest one, first the larger, then the smaller neighbours, until every
    component is one star.  What a round leaves is written to shared storage; nothing but its digest
    comes to the driver."""
    now = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(MOST_ROUNDS):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("node", F.col("node").alias("component")))
