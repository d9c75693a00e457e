"""Nearest neighbours of vectors within a time window (R-02, R-03, F-40)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours kept, least likeness, window in days, and the rules of "same event".
TOP, RELATED, WINDOW, SAME, SAME_DAYS, CROSS, CROSS_DAYS = 5, 0.88, 60, 0.95, 3, 0.92, 7
#: Rows a block of the product, and rows of it that are multiplied at once.
BLOCK, TILE = 8192, 256


def spread(rows: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(id, vec, day) to side (0, 1), id, vec, day and the pair of blocks (ca, pa, cb, pb) where they meet: those of a row's own cell of `window` days and the cells beside it.

    A row travels twice for each block in reach, so what is shuffled is the number of rows times that of blocks: the product of all pairs is quadratic, and blocks are as large
    as a task's memory allows (a tile of the product and two blocks of vectors).  A row without a day meets rows without a day."""
    own = rows.withColumn("cell", F.floor(F.col("day") / window))
    sizes = own.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    counted = sizes.withColumnRenamed("cell", "c1")
    cut = own.join(counted, F.col("cell").eqNullSafe(F.col("c1"))).select("id", "vec", "day", "cell", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("part"))
    across = F.when(F.col("cell").isNull(), F.array(F.col("cell"))).otherwise(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
    met = cut.select("id", "vec", "day", "cell", "part", F.explode(across).alias("other")).join(sizes.select(F.col("cell").alias("c2"), F.col("blocks").alias("b2")), F.col("other").eqNullSafe(F.col("c2")))
    left = met.select(F.lit(0).alias("side"), "id", "vec", "day", F.col("cell").alias("ca"), F.col("part").alias("pa"), F.col("other").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("b2") - 1)).alias("pb"))
    right = met.select(F.lit(1).alias("side"), "id", "vec", "day", F.col("other").alias("ca"), F.explode(F.sequence(F.lit(0), F.col("b2") - 1)).alias("pa"), F.col("cell").alias("cb"), F.col("part").alias("pb"))
    return left.unionByName(right)


def neighbours(rows: DataFrame, top: int = TOP, least: float = RELATED, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(id, vec, day) to (id, other, similarity, gap): each row's `top` nearest others by cosine within `window` days.

    A task multiplies one pair of blocks (see spread()), some rows at a time, and returns at most `top` rows an id, so no group grows with a cell."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = {"id": [], "other": [], "similarity": [], "gap": []}
        if len(a) and len(b):
            unit = lambda x: (m := np.array(x.tolist(), np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            mine, theirs, ids, others, days = unit(a.vec), unit(b.vec).T, a.id.to_numpy(), b.id.to_numpy(), b.day.to_numpy(float)
            for at in range(0, len(a), TILE):
                own = slice(at, at + TILE)
                sims = mine[own] @ theirs
                gap = np.abs(a.day.to_numpy(float)[own, None] - days[None, :])
                sims[(gap > window) | (ids[own, None] == others[None, :])] = -2
                for i in range(len(sims)):
                    best = np.flatnonzero(sims[i] >= least)
                    best = best[np.lexsort((others[best], -np.round(sims[i, best], 9)))][:top]  # ties by id, as in the end
                    out["id"] += [ids[at + i]] * len(best)
                    out["other"] += others[best].tolist()
                    out["similarity"] += sims[i, best].tolist()
                    out["gap"] += [int(g) if g == g else 0 for g in gap[i, best]]
        return pd.DataFrame(out).astype({"id": "int64", "other": "int64", "similarity": "float64", "gap": "int64"})

    found = spread(rows, window, block).groupBy("ca", "pa", "cb", "pb").applyInPandas(product, "id long, other long, similarity double, gap long")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def same_event(similarity, gap, lang_a, lang_b, cross_langs: tuple[str, ...] = ("id", "en")):
    """Whether two linked incidents are one event: very alike and close, or alike across languages (R-03)."""
    cross = (lang_a != lang_b) & (lang_a.isin(*cross_langs) | lang_b.isin(*cross_langs))
    return ((similarity >= SAME) & (gap <= SAME_DAYS)) | (cross & (similarity >= CROSS) & (gap <= CROSS_DAYS))
