"""Positions in a global order, and exact order statistics, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.storage import materialize

#: Bins of a pass over a range of values.
BINS = 4096
#: Bits below the number of a partition in monotonically_increasing_id().
_ROW_BITS = 33


def row_index(df: DataFrame, key: str, name: str = "idx", buckets: int | None = None) -> DataFrame:
    """Adds the row's position (from 0) in ascending order of a key; ties by the other columns' hash, null keys first.

    Spark deals rows out by ranges of the key and sorts each range, so a row's number inside its partition is known where it lies; the rows are written with it, and the
    partitions' counts, one row each, give the offsets.  The plan is the same for any number of ranges."""
    n = buckets or max(4, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # everything but the key travels in one struct, so no column's name can clash
    placed = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(*[f"`{c}`" for c in df.columns if c != key]).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    ordered = placed.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie").withColumn("at", F.monotonically_increasing_id())
    inside = materialize(ordered.select("row", F.shiftright("at", _ROW_BITS).alias("range"), F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("i")), "ranges")
    counts = inside.groupBy("range").agg(F.count("*").alias("n"))
    # one row a range: so few that a window without partitions is harmless
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return inside.join(before, "range").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], (F.col("before") + F.col("i")).alias(name))


def order_statistics(df: DataFrame, wanted: list[tuple[Column, list[int]]]) -> list[list[float]]:
    """Of each column of doubles its values at given ranks (from 0, nulls left out), exactly.

    A pass counts the values of the range in which a rank lies in BINS bins of equal width, all columns and ranks at once, and goes on with the rank's bin between
    its least and greatest value, until those are equal.  BINS rows a rank come to the driver in a pass, whatever the number of rows.  Values must be finite."""
    columns = df.select(*[c.cast("double").alias(f"x{i}") for i, (c, _) in enumerate(wanted)])
    ends = columns.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(wanted)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    open_ = {(i, k): (ends[f"lo{i}"], ends[f"hi{i}"], 0) for i, (_, ranks) in enumerate(wanted) for k in ranks}
    while moving := {t: r for t, r in open_.items() if r[0] is not None and r[0] < r[1]}:
        tasks = sorted(moving)
        bins = [F.when(F.col(f"x{i}").between(lo, hi), F.struct(F.lit(n).alias("t"), F.least(F.floor((F.col(f"x{i}") - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).alias("bin"), F.col(f"x{i}").alias("x"))) for n, (i, k) in enumerate(tasks) for lo, hi, _ in [moving[i, k]]]
        found = columns.select(F.explode(F.array_compact(F.array(*bins))).alias("b")).groupBy("b.t", "b.bin").agg(F.count("*").alias("n"), F.min("b.x").alias("lo"), F.max("b.x").alias("hi"))
        seen: dict = {}
        for r in sorted(found.collect()):
            seen.setdefault(r["t"], []).append(r)
        for n, (i, k) in enumerate(tasks):
            base = moving[i, k][2]
            for r in seen[n]:
                if k < base + r["n"]:
                    open_[i, k] = r["lo"], r["hi"], base
                    break
                base += r["n"]
    return [[open_[i, k][0] for k in ranks] for i, (_, ranks) in enumerate(wanted)]


def medians(df: DataFrame, columns: list[Column]) -> list[float | None]:
    """Exact medians of columns of finite doubles, nulls left out: the middle value, or the mean of the two."""
    counts = df.select(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    ranks = [[(n - 1) // 2, n // 2] if n else [] for n in counts]
    return [sum(v) / 2 if v else None for v in order_statistics(df, list(zip(columns, ranks)))]
