"""Token ids in binary files of patched frame-of-reference blocks.

A file holds a run of documents in ascending doc_id order.  Their ids, end to end, are cut into
blocks.  Of each block the smallest id is subtracted; a high percentile of the rest picks the width in
bits at which all are packed; ids too large for it keep their low bits there and stand, with what
exceeds the width, in the block's exception list.  An index gives where each block starts, so
that any document can be read alone.  A manifest of one row a file holds how many ids come before it.

Layout, little-endian: magic "PFR1"; uint32 documents, blocks, ids, ids a block; then arrays: doc_id int64 and
first id uint32 of each document; minimum uint32, width uint8, exceptions uint32 and byte offset uint32 of each block;
exception places uint16 and high parts uint32 of all blocks; the packed bits, each block at a full byte.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import bucket_of, fresh_path, materialize, range_buckets, table, text_ranges
from casebook.llm.vocab import slices, word_encoder

MAGIC, HEAD = b"PFR1", struct.Struct("<4sIIII")
BLOCK, PERCENTILE = 1024, 98.0
#: Ids after which a file ends at the next document.
FILE_IDS = 8_000_000
#: Stands for a null doc_id in files, and reads back as null.
NO_ID = -(1 << 63)
#: Files a block of the prefix sums over the manifest.
FILE_BLOCK = 4096


def pack_ids(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The file's bytes for documents with so many ids each."""
    n = len(ids)
    blocks = -(-n // block)
    low, width, counts = np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint8), np.zeros(blocks, np.uint32)
    bits, places, highs = [], [], []
    step = 256  # blocks packed at a time
    for b in range(0, blocks, step):
        part = ids[b * block : (b + step) * block]
        k = -(-len(part) // block)
        grid = np.full(k * block, part[-1], np.uint32)
        grid[: len(part)] = part
        grid = grid.reshape(k, block)
        low[b : b + k] = grid.min(1)
        rest = grid - low[b : b + k, None]
        at = min(block - 1, int(block * percentile / 100))
        top = np.partition(rest, at, axis=1)[:, at]
        wide = np.frompyfunc(int.bit_length, 1, 1)(top.astype(object)).astype(np.uint8)
        width[b : b + k] = wide
        over = rest >> wide[:, None]
        over.reshape(-1)[len(part) :] = 0
        row, place = np.nonzero(over)
        counts[b : b + k] = np.bincount(row, minlength=k)
        places.append(place.astype(np.uint16))
        highs.append(over[row, place])
        packed = [b""] * k
        for w in np.unique(wide).tolist():
            own = np.flatnonzero(wide == w)
            if w:
                spread = (rest[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
                rows = np.packbits(spread.astype(np.uint8).reshape(len(own), block * w), axis=1, bitorder="little")
                for i, r in zip(own.tolist(), rows):
                    packed[i] = r.tobytes()
        bits += packed
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bits])])[:blocks].astype(np.uint32)
    first = (np.cumsum(sizes) - sizes).astype(np.uint32)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    arrays = [doc_ids.astype("<i8"), first, low, width, counts, starts, join(places, np.uint16), join(highs, np.uint32)]
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), blocks, n, block), *(x.tobytes() for x in arrays), *bits])


class TokenFile:
    """Reads a file's bytes; blocks are unpacked when asked for."""

    def __init__(self, raw: bytes):
        magic, docs, blocks, self.n, self.block = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.first = take("<i8", docs), take("<u4", docs)
        self.low, self.width, counts, self.starts = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u4", blocks)
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.places, self.highs = take("<u2", int(self.ends[-1])), take("<u4", int(self.ends[-1]))
        self.bits = np.frombuffer(raw, np.uint8, offset=at)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks first..last - 1."""
        out = np.empty((last - first, self.block), np.uint32)
        width = self.width[first:last]
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            size = self.block * w // 8
            if not w:
                out[own] = 0
                continue
            raw = self.bits[self.starts[first + own].astype(np.int64)[:, None] + np.arange(size)]
            spread = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), self.block, w)
            whole = np.zeros((len(own), self.block), np.uint32)
            for bit in range(w):
                whole |= spread[:, :, bit].astype(np.uint32) << np.uint32(bit)
            out[own] = whole
        a, b = self.ends[first], self.ends[last]
        row = np.repeat(np.arange(last - first), np.diff(self.ends[first : last + 1]))
        out[row, self.places[a:b]] |= self.highs[a:b] << width[row].astype(np.uint32)
        out += self.low[first:last, None]
        return out.reshape(-1)[: self.n - first * self.block]

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the file's first-th on."""
        if not n:
            return np.zeros(0, np.uint32)
        b = first // self.block
        return self.blocks(b, -(-(first + n) // self.block))[first - b * self.block :][:n]

    def documents(self, step: int = 128):
        """(doc_id, first id, ids) of all documents, a few blocks in memory at a time."""
        ends = np.append(self.first[1:], self.n).astype(np.int64)
        at, held, base = 0, np.zeros(0, np.uint32), 0
        for doc, first, end in zip(self.doc_ids.tolist(), self.first.tolist(), ends.tolist()):
            while base + len(held) < end:
                stop = min(at + step, len(self.low))
                held = np.concatenate([held[first - base :], self.blocks(at, stop)])
                base, at = first, stop
            yield doc, first, held[first - base : end - base]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> DataFrame:
    """Writes (doc_id, text) under `path`, a shared folder; returns the manifest: file, n_docs, n_ids, before.

    A null text counts as empty; each document ends with end_id.  Rows with a null doc_id come first, as NO_ID; rows with
    the same doc_id stay side by side.  A retried task writes the same file again."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    ranges, tasks = text_ranges(own)
    cuts = range_buckets(own, "doc_id", ranges)
    parts = max(-(-(len(cuts) + 1) // 4), tasks)
    ordered = own.withColumn("file", bucket_of(F.col("doc_id"), cuts).cast("long")).repartition(parts, "file").sortWithinPartitions("file", "doc_id", F.xxhash64("text"))

    def store(batches):
        tokens = word_encoder(vocabulary)
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder)
        held, now, part = ([], [], []), None, 0

        def flush():
            doc_ids, sizes, ids = (np.concatenate(x) for x in held)
            raw = pack_ids(doc_ids, sizes, ids)
            with files.open_output_stream(f"{folder}/{now << 20 | part:016d}.pfr") as out:
                out.write(raw)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([now << 20 | part]), pa.array([len(doc_ids)]), pa.array([len(ids)])], names=["file", "n_docs", "n_ids"])

        for batch in batches:
            file = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.diff(file)) + 1
            for a, b in zip([0, *edges], [*edges, len(file)]):
                if a == b:
                    continue
                if now is not None and file[a] != now:
                    yield flush()
                    part = 0
                now = int(file[a])
                for at, texts in slices(batch.column(2).slice(a, b - a)):
                    if held[0] and sum(map(len, held[2])) >= FILE_IDS:
                        yield flush()
                        part += 1
                    ids, begin = tokens.encode(texts)
                    held[0].append(np.asarray(batch.column(1).slice(a + at, len(texts))))
                    held[1].append(np.diff(begin) + 1)
                    held[2].append(np.insert(ids, begin[1:], end_id).astype(np.uint32))
        if held[0]:
            yield flush()

    written = ordered.select("file", "doc_id", "text").mapInArrow(store, "file long, n_docs long, n_ids long")
    manifest = materialize(written, "manifest")
    blocked = manifest.withColumn("block", F.expr(f"shiftright(file, 20) div {FILE_BLOCK}"))
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("file")) - F.col("n_ids")
    blocks = blocked.groupBy("block").agg(F.sum("n_ids").alias("sum"))
    base = blocks.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("base"))
    return blocked.withColumn("inside", inside).join(base, "block").select("file", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("before"))


def read_token_files(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32[, ids]."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def load(batches):
        files, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{folder}/{file:016d}.pfr") as raw:
                    found = TokenFile(raw.read())
                rows = []
                for doc, first, ids in found.documents():
                    rows.append((doc if doc != NO_ID else None, before + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else [])))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    n = max(1, manifest.count() // 4)
    spread = manifest.select("file", "before").repartition(n)
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back: one row for each row.

    A null or empty text has the end id alone; a text of any length lies in one file; rows that share a doc_id lie side by side in the order of their texts' hashes;
    a null doc_id comes first and reads back as null; other columns don't matter.  An empty table gives an empty table."""
    import public_tokenizers as vocabularies

    path = fresh_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"), 1, path), path)
