"""Best-fit packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing works on lengths alone, so it runs on their histogram: at most `capacity`
distinct lengths, whatever the corpus.  Longest first, each run of equal pieces goes to the
tightest class of open bins (a segment tree over remaining capacities finds it in logarithmic
time), and the plan notes which ranks of a length go to which bins.  Spark numbers the pieces of
each length, sharded so that no length meets in one task, and looks the ranks up in the plan.  The
packing is that of one global best-fit run; the plan's size depends on the capacity, not on the rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import free_names, materialize, release, shuffle_partitions, table
from casebook.llm.vocab import byte_encoder, slices

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity, each leaf counting its open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= need that has an open bin."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over a histogram of lengths (1..capacity).

    Returns runs: pieces of `length` with ranks from `rank` on go, one each, to bins from `bin` on,
    at `offset`.  Runs are sorted by (length, rank)."""
    tree, free = CapacityTree(capacity), defaultdict(deque)
    runs: list[tuple[int, int, int, int]] = []
    bins = 0

    def keep(remaining: int, first: int, n: int) -> None:
        free[remaining].append((first, n))
        tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (r := tree.tightest(length)) is not None:
            first, n = free[r].popleft()
            m = min(n, left)
            if m < n:
                free[r].appendleft((first + m, n - m))
            tree.add(r, -m)
            runs.append((length, rank, first, capacity - r))
            keep(r - length, first, m)
            rank, left = rank + m, left - m
        each = capacity // length
        for n, per in ((left // each, each), (1, left % each)):
            if n and per:
                for k in range(per):
                    runs.append((length, rank, bins, k * length))
                    rank += n
                keep(capacity - per * length, bins, n)
                bins += n
    runs.sort()
    return dict(zip(("length", "rank", "bin", "offset"), np.array(runs, np.int64).reshape(-1, 4).T))


def token_pieces(docs: DataFrame, path: str, ranks: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32[, ids].

    A null text counts as empty.  Each document ends with end_id.  Of a longer document the first
    piece holds what the full ones leave."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        tokens = byte_encoder(path, ranks, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, begin = tokens.encode(texts)
                ids = np.insert(ids, begin[1:], end_id).astype("<u4")
                sizes = np.diff(begin) + 1
                begin = np.concatenate([[0], np.cumsum(sizes)])
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = sizes - capacity * (pieces - 1)
                start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
                length = np.where(piece == 0, first[row], capacity)
                lo = (begin[row] + start).tolist()
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(lo, length.tolist())]
                columns = [batch.column(0).slice(at, len(sizes)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1..capacity, as best-fit decreasing packs them.

    Rows with a null length or one outside that range are refused by an error.  Repeated rows are
    packed one by one.  Other columns keep their names; a sequence_id or offset that was there is replaced.  An empty table gives an empty table.  `pieces` is read three times: it should be
    cheap to read, as a written table is."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    shards = max(64, 4 * shuffle_partitions(spark))
    keys = [c for c in ("doc_id", "piece") if c in pieces.columns] or ["length"]
    shard, rank, before, n = free_names(pieces.columns, "shard", "rank", "before", "n")
    sized = pieces.withColumn(shard, F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    each = sized.groupBy("length", shard).agg(F.count("*").alias(n))
    bases = each.select("length", shard, (F.sum(n).over(Window.partitionBy("length").orderBy(shard)) - F.col(n)).alias(before))
    histogram = {row[0]: row[1] for row in each.groupBy("length").agg(F.sum(n)).collect()}  # `capacity` rows at most
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = plan_bins(histogram, capacity)
    keyed = (plan["length"] << 44) | plan["rank"]
    ranked = (
        sized.withColumn(rank, F.row_number().over(Window.partitionBy("length", shard).orderBy(*keys)) - 1)
        .join(bases, ["length", shard])
        .select(*[F.col(f"`{c}`") for c in names], (F.col(rank) + F.col(before)).cast("long").alias(rank))
    )

    def place(batches):
        for batch in batches:
            own = np.asarray(batch.column(rank))
            at = np.searchsorted(keyed, (np.asarray(batch.column("length")).astype(np.int64) << 44) | own, "right") - 1
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(plan["bin"][at] + own - plan["rank"][at]), pa.array(plan["offset"][at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows of best_fit that carry `ids`, put together: sequence_id, ids, doc_ids in order of offset.

    A group is one sequence: never more than its capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("x")).select(
        "sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) to packed pieces with the public byte vocabulary."""
    import public_tokenizers as vocabularies

    path = vocabularies.path
    pieces = token_pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, capacity)
    return best_fit(materialize(pieces, "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed: one row a piece.

    A null or empty text is a piece of the end id alone; a text of any length is cut into pieces and none is lost; repeated rows are packed one by one; a null
    doc_id stays null; other columns don't matter.  Among equal lengths the order is by hash and doc_id.  An empty table gives an empty table."""
    return pack_documents(table(spark, sf_dir, "documents"))
