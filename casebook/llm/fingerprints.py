"""Bottom-k sketches of word shingles.

A document's sketch is the k smallest distinct hashes of its five-word shingles (fewer words: the whole
sequence is one shingle; no words: no shingle).  Sketches of parts merge to the sketch of the whole by keeping the k
smallest again.  From two sketches come estimates of resemblance and containment, from one the number of
distinct shingles; all are exact while the sets hold at most k shingles.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import bucket_of, range_buckets, table, text_ranges
from casebook.llm.vocab import slices

K, WORDS = 128, 5
#: Bytes of a text that are sketched in one go.
PART_BYTES = 1 << 15
_SPACES, _GAP = b" \t\n\v\f\r", re.compile(rb"[\x20\x09-\x0D]")
#: Fixed odd multipliers of the hash.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS = np.empty(0, np.uint64)
_INVERSE = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, 1 << 16)
        fill = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
        _POWERS, _INVERSE = fill(BASE), fill(pow(BASE, -1, 1 << 64))
    return _POWERS[:n], _INVERSE[:n]


def shingle_hashes(raw: np.ndarray, begin: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts (bytes end to end, begin: where each starts, one more entry), and where each text's start.

    ASCII letters count as lower-case; a word is a run of bytes but space and \\t..\\r."""
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    gap = (lower == 32) | ((lower >= 9) & (lower <= 13))
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = gap[:-1] if len(raw) else edge[1:-1]
    edge[begin] = True
    inside = np.append(~gap, False)
    heads = np.flatnonzero(edge[:-1] & inside[:-1])
    stop = np.append(gap, True)
    stop[begin[1:]] = True
    tails = np.flatnonzero(stop[1:] & inside[:-1]) + 1
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[lower] * power[: len(raw)], out=total[1:])
    word = _mix((total[tails] - total[heads]) * inverse[heads] + (tails - heads).astype(np.uint64))
    first = np.searchsorted(heads, begin)  # of each text, its first word
    n = np.diff(first)
    shingles = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    starts = np.cumsum(shingles) - shingles
    at = np.repeat(first[:-1] - starts, shingles) + np.arange(int(shingles.sum()))
    size = np.repeat(np.minimum(n, words), shingles)
    out = size.astype(np.uint64)
    for k in range(words):
        live = size > k
        out[live] = _mix(out[live] * np.uint64(BASE) + word[at[live] + k])
    return out, np.append(starts, len(out))


def parts_of(text: bytes, words: int = WORDS, size: int | None = None) -> list[bytes]:
    """A text's parts of about `size` bytes (PART_BYTES), cut between words, each beginning with the last words - 1 words of the one before: every shingle of the
    text stands in one of them, and no other does."""
    size = size or PART_BYTES
    if len(text) <= size:
        return [text]
    out, lead, at = [], b"", 0
    while at < len(text):
        end = at
        while True:  # a part has `words` words at least
            gap = _GAP.search(text, min(end + size, len(text)))
            end = gap.start() if gap else len(text)
            part = lead + text[at:end]
            if end == len(text) or len(part.split(None, words)) >= words:
                break
        rest = text[end:]
        if not rest.strip(_SPACES):
            out.append(part + rest)
            break
        out.append(part)
        lead, at = b" ".join(part.rsplit(None, words - 1)[-(words - 1) :]) if words > 1 else b"", end
    return out


def sketch_arrays(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sketch of each text: ascending hashes.  A text of more than PART_BYTES is sketched part by part, and the parts' sketches are merged."""
    out: list[np.ndarray | None] = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= PART_BYTES]
    for i, own in zip(short, _whole_sketches([texts[i] for i in short], k, words)):
        out[i] = own
    for i, found in enumerate(out):
        if found is None:
            whole = np.empty(0, np.uint64)
            for part in parts_of(texts[i], words):
                whole = merge(whole, _whole_sketches([part], k, words)[0], k)
            out[i] = whole
    return out


def _whole_sketches(texts: list[bytes], k: int, words: int) -> list[np.ndarray]:
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, cuts = shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), begin, words)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = hashes[a:b]
        if b - a > 8 * k:  # enough for the k smallest distinct ones, unless many repeat
            few = np.unique(np.partition(own, 4 * k)[: 4 * k])
            own = few if len(few) >= k else own
        out.append(np.unique(own)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest that both hold; of two empty sets: 1."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of all."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b holds too; of an empty a: 1."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, both / distinct_shingles(a, k))


def to_text(sketch: np.ndarray) -> str:
    """Base 64 of the big-endian hashes."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, text) to doc_id, fingerprint, n_shingles (estimated).  A null text counts as empty."""
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), 2_000_000):
                own = sketch_arrays([t.encode() for t in pc.fill_null(texts, "").to_pylist()], k, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(list(map(to_text, own)), pa.string()), pa.array([distinct_shingles(x, k) for x in own], pa.float64())],
                    names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merge_fingerprints(df: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key from those of its parts: merged within partitions first, then once a key.

    What meets in a task is, of one key, at first a part of the partitions' sketches, then 256 sketches."""
    def partial(batches):
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = from_text(text or "")
                held[name] = merge(held[name], own, k) if name in held else own
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), pa.array(list(map(to_text, held.values())), pa.string())], names=[key, column])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), pa.array(list(map(to_text, held.values())), pa.string())], names=[key, column])

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(key, column).mapInArrow(partial, f"`{key}` {kind}, `{column}` string")

    def last(pdf):
        own = np.empty(0, np.uint64)
        for text in pdf[column]:
            own = merge(own, from_text(text), k)
        return pdf.iloc[:1].assign(**{column: to_text(own)})

    salted = parts.withColumn("salt", F.pmod(F.xxhash64(column), F.lit(256)).cast("int"))
    once = salted.groupBy(key, "salt").applyInPandas(last, f"`{key}` {kind}, `{column}` string, salt int")
    return once.groupBy(key).applyInPandas(last, f"`{key}` {kind}, `{column}` string, salt int").drop("salt")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) in which each bucket holds its documents in ascending doc_id order and, as a
    guest at the end, the first document of the bucket after it; the last bucket's guest is the very first document.

    Rows of one doc_id stay in one bucket, ordered by their text's hash."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges, tasks = text_ranges(own)
    cuts = range_buckets(own, "doc_id", ranges)
    rows = own.withColumn("bucket", bucket_of(F.col("doc_id"), cuts))
    firsts = own.select(bucket_of(F.col("doc_id"), cuts).alias("bucket"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("first"))
    found = sorted((r["bucket"], r["first"]) for r in firsts.collect())  # one row a bucket
    if not found:
        return rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    before = {first: found[i - 1][0] for i, (_, first) in enumerate(found)}
    hosts = spark.createDataFrame(list(before.items()), "first long, host int")
    key = F.coalesce("doc_id", F.lit(-(1 << 62)))
    guests = rows.join(F.broadcast(hosts), key == hosts["first"]).select(F.col("host").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    parts = max(-(-len(found) // 4), tasks)
    return (
        rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").union(guests)
        .repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", F.xxhash64("text"))
    )


def compare_with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and that to the next document's.

    Edited: the last quarter of the characters gives way to the first as many of the next document.  Beside them, all from the sketches: how many distinct shingles
    the text has, how many it has together with the next document (their merged sketch), and which share of its shingles the edited text holds.

    One row for each row; rows that share a doc_id follow each other in the order of their texts' hashes.  A null text counts as empty and has the empty sketch; two
    empty texts are alike; a null doc_id comes first.  A single document is its own next one.  An empty table gives an empty table."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "n_distinct_with_next", "kept_by_edit"]

    def run(batches):
        held: tuple | None = None  # the last document, waiting for its next

        def emit(rows):
            plain = [r[0].encode() for r in rows]
            own = sketch_arrays(plain, k)
            edited = [r[0][: len(r[0]) - len(r[0]) // 4] + r[1][: len(r[0]) // 4] for r in rows]
            raw = [t.encode() for t in edited]
            new = sketch_arrays(raw, k)
            nxt = sketch_arrays([rows[-1][1].encode()], k)
            after = [own[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == rows[i][1] else None for i in range(len(rows))]
            after = [x if x is not None else (nxt[0] if i == len(rows) - 1 else sketch_arrays([rows[i][1].encode()], k)[0]) for i, x in enumerate(after)]
            columns = [
                pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                pa.array(list(map(to_text, own)), pa.string()), pa.array(list(map(to_text, new)), pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()), pa.array([resemblance(a, b, k) for a, b in zip(own, after)], pa.float64()),
                pa.array([distinct_shingles(a, k) for a in own], pa.float64()), pa.array([distinct_shingles(merge(a, b, k), k) for a, b in zip(own, after)], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, new)], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows, size = [], 0
        for batch in batches:
            for at, part in slices(batch.column(3), 1_000_000):
                where = batch.slice(at, len(part))
                for bucket, guest, doc, text in zip(*(where.column(i).to_pylist() for i in range(4))):
                    if held is not None and held[0] == bucket and not (guest and held[3]):
                        rows.append((held[2], text, held[1]))
                        size += len(held[2])
                        if size >= 1_000_000:
                            yield emit(rows)
                            rows, size = [], 0
                    held = (bucket, doc, text, guest) if not guest else None
        if rows:
            yield emit(rows)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, n_distinct_with_next double, kept_by_edit double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, as compare_with_next() defines them for nulls, empty and very long texts, repeated rows and empty tables."""
    return compare_with_next(table(spark, sf_dir, "documents"))
