"""Recall of the index against brute force, and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import vector_index


def exact(ids, vectors, queries, top=5):
    v = vector_index.unit(np.array(vectors, np.float64))
    out = {}
    for q in queries:
        sims = v @ v[ids.index(q)]
        near = sorted((-round(s, 9), i) for s, i in zip(sims.tolist(), ids) if i != q)[:top]
        out[q] = {i for _, i in near}
    return out


def recall(found, true):
    got = {}
    for r in found:
        got.setdefault(r["id"], set()).add(r["other"])
    return sum(len(got.get(q, set()) & t) for q, t in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    held = sorted((r["id"], r["vec"]) for r in rows.collect())
    ids, vectors = [i for i, _ in held], [v for _, v in held]
    found = vector_index.search(rows.where("id % 20 = 0"), rows, vector_index.fit(rows)).collect()
    true = exact(ids, vectors, [i for i in ids if i % 20 == 0])
    share = recall(found, true)
    print(f"recall {sf}: {share:.3f}")
    assert share >= 0.9


def test_cells_are_fewer_than_rows_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    vectors = [(centers[i % 12] + 0.3 * rng.normal(size=16)).tolist() for i in range(900)]
    monkeypatch.setattr(vector_index, "CELL_ROWS", 40)
    df = spark.createDataFrame([*enumerate(vectors), (5000, None)], "id long, vec array<double>")
    index = vector_index.fit(df)
    assert len(index.centroids) == 22 and 1 <= index.probes < 12
    asked = df.where("id % 20 = 0")
    whole = sorted(map(tuple, vector_index.search(asked, df, index).collect()))
    assert sorted(map(tuple, vector_index.search(asked, df, index, block=7).collect())) == whole
    assert recall([{"id": a, "other": b} for a, b, _ in whole], exact(list(range(900)), vectors, range(0, 900, 20))) >= 0.9


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert vector_index.search(none, none, vector_index.fit(none)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vec array<double>")
    assert vector_index.search(one, one, vector_index.fit(one)).count() == 0
