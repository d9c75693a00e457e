"""An inverted-file index of vectors: cells around centroids, searched in the cells nearest to a query (J-18, R-02 at scale).

Centroids are fitted on a bounded sample (SAMPLE vectors, the first by a hash of id); every row is assigned to a cell.  How many cells a query looks into is chosen on the
sample: the fewest with which TRIALS sampled queries find at least RECALL of their true neighbours.  Cells and their readers are cut into blocks, and a task multiplies one
block of each, so neither a large cell nor a busy one is a task.  vectors.neighbours is the exact form."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the fit reads, queries it tries, share of true neighbours that they must find, rows a cell on average, most cells, rounds of the fit, rows a block.
SAMPLE, TRIALS, RECALL, CELL_ROWS, MOST_CELLS, ROUNDS, BLOCK = 20_000, 256, 0.97, 256, 1024, 12, 2048


class Index(NamedTuple):
    centroids: np.ndarray
    probes: int


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; a zero vector stays."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit(rows: DataFrame, top: int = 5, seed: int = 1) -> Index:
    """Centroids and probes for (id, vec) rows, from SAMPLE of them; null vectors are left out."""
    own = rows.where("vec IS NOT NULL")
    n = own.count()
    if not n:
        return Index(np.zeros((0, 0)), 0)
    held = unit(np.array([r["vec"] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], np.float64))
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS, len(held) // 8))
    rng = np.random.default_rng(seed)
    centers = held[rng.choice(len(held), cells, replace=False)]
    for _ in range(ROUNDS):
        home = (held @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, held)
        full = np.bincount(home, minlength=cells) > 0
        centers[full] = unit(sums[full])
    home = (held @ centers.T).argmax(1)
    asked = rng.choice(len(held), min(TRIALS, len(held)), replace=False)
    sims = held[asked] @ held.T
    sims[np.arange(len(asked)), asked] = -2
    true = np.argsort(-sims, axis=1)[:, : min(top, len(held) - 1)]
    rank = np.argsort(np.argsort(-(held[asked] @ centers.T), axis=1), axis=1)  # of each cell for each query
    needed = np.take_along_axis(rank, home[true], axis=1)
    probes = next((p for p in range(1, cells + 1) if not needed.size or (needed < p).mean() >= RECALL), cells)
    return Index(centers, probes)


def _cells(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """Rows with the `probes` cells nearest to their vector."""
    centers = index.centroids

    @F.arrow_udf("array<int>")
    def nearest(vec: pa.Array) -> pa.Array:
        flat = np.asarray(vec.flatten(), np.float64).reshape(len(vec), -1)
        best = np.argsort(-(unit(flat) @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.array(list(best), pa.list_(pa.int32()))

    return rows.where("vec IS NOT NULL").withColumn("cells", nearest(F.col("vec").cast("array<double>")))


def search(queries: DataFrame, rows: DataFrame, index: Index, top: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, vec) queries and rows to (id, other, similarity): each query's `top` nearest other rows by cosine among the cells it looks into, ties by id.

    Every row is in one cell; a null vector finds nothing and isn't found."""
    kind = "id long, other long, similarity double"
    if not index.probes:
        return queries.sparkSession.createDataFrame([], kind)
    placed = _cells(rows.select("id", "vec"), index, 1).select("id", "vec", F.get("cells", F.lit(0)).alias("cell"))
    looking = _cells(queries.select("id", "vec"), index, index.probes).select("id", "vec", F.explode("cells").alias("cell"))
    size = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    sizes = size(placed, "rows").join(size(looking, "askers"), "cell")  # one row a cell
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = looking.join(F.broadcast(sizes), "cell").select(F.lit(0).alias("side"), "id", "vec", "cell", hashed("askers").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"))
    b = placed.join(F.broadcast(sizes), "cell").select(F.lit(1).alias("side"), "id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("i"), hashed("rows").alias("j"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "similarity": []}).astype({"id": "int64", "other": "int64", "similarity": "float64"})
        matrix = lambda z: unit(np.array(z.vec.tolist(), np.float64))
        sims, others = matrix(x) @ matrix(y).T, y.id.to_numpy()
        sims[x.id.to_numpy()[:, None] == others[None, :]] = -2
        order = np.lexsort((np.broadcast_to(others, sims.shape), -np.round(sims, 9)), axis=1)[:, :top]
        found = np.take_along_axis(sims, order, axis=1)
        out = pd.DataFrame({"id": np.repeat(x.id.to_numpy(), order.shape[1]), "other": others[order].ravel(), "similarity": found.ravel()})
        return out[out.similarity > -1.5]

    met = a.unionByName(b).groupBy("cell", "i", "j").applyInPandas(product, kind)
    ranked = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    return met.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= top).drop("k")
