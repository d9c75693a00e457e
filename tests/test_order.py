"""Exact order statistics by passes, and positions by Spark's own ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from casebook.operators import ordering


@pytest.mark.parametrize("bins", [3, 4096])
def test_medians_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(ordering, "BINS", bins)
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1) * 1e12, 5.0]), float(rng.randrange(3)), None, float(i)) for i in range(501)] + [(1e-300, 2.0, None, None)]
    found = ordering.medians(spark.createDataFrame(rows, "a double, b double, c double, d double"), [F.col(c) for c in "abcd"])
    for value, column in zip(found, zip(*rows)):
        known = [x for x in column if x is not None]
        assert value == (statistics.median(known) if known else None)


def test_order_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.choice([rng.random(), 0.25]),) for _ in range(300)]
    assert ordering.order_statistics(spark.createDataFrame(rows, "x double"), [(F.col("x"), [0, 7, 150, 299])]) == [[sorted(rows)[k][0] for k in (0, 7, 150, 299)]]


def test_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(50)]), i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, `range` string")
    for buckets in (1, 9):
        found = ordering.row_index(df, "k", buckets=buckets).orderBy("idx").collect()
        assert [r["idx"] for r in found] == list(range(300)) and sorted(r["i"] for r in found) == list(range(300))
        assert [r["k"] for r in found] == sorted((k for k, _, _ in rows), key=lambda k: (k is not None, k or 0))
    few, many = (len(ordering.row_index(df, "k", buckets=n)._jdf.queryExecution().analyzed().toString()) for n in (4, 200))
    assert abs(few - many) < 10
