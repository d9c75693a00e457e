"""Centroid clustering (Lloyd's rounds) over subvector dictionaries, in exact integers.

Vectors are written once as pages.  A page cuts its vectors into blocks of components and keeps, of each block, the
distinct subvectors and one code a vector: nothing is lost, and a subvector that a million vectors share is there once.
A round computes the exact distance of every distinct subvector to the matching part of every centroid once, and a
vector's distance is the sum of its codes' partial distances.  The new centroids' sums come from the same dictionaries:
how often each code fell to each cluster, times the subvector.  Pages stand alone, so a round has no shuffle but that of
one row a task and cluster, and a lost page is read again from shared storage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import discard, materialize, table

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors a page; widths of a block, widest first: a block is kept if its distinct subvectors are at most a SHARE-th of the page's vectors.
PAGE, WIDTHS, SHARE = 8192, (16, 4, 1), 4
#: Scaled components stay below this, so that no distance exceeds a long.
LARGEST = 1 << 27


def kept_vectors(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, embedding) rows whose vector has exactly `size` components, all finite."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where((F.size("embedding") == size) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles."""
    found = np.floor(scale * vectors)
    if len(found) and np.abs(found).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // scale} or more in size has no distance that fits a long")
    return found.astype(np.int64)


def first_centroids(kept: DataFrame, n: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:vec_id`, in that order; of equal ids the smaller vector comes first, and a null id is never one."""
    own = kept.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    return integers(np.array([r["embedding"] for r in own.orderBy("h", "embedding").limit(n).collect()], np.float64))


def dictionary_blocks(vectors: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first component, width, distinct subvectors, code of each vector): the widest blocks whose dictionaries are small, else single components."""
    out, at, size = [], 0, vectors.shape[1]
    while at < size:
        for width in WIDTHS:
            if at % width or at + width > size:
                continue
            part = np.ascontiguousarray(vectors[:, at : at + width])
            if width == 1:
                distinct, codes = np.unique(part[:, 0], return_inverse=True)
                distinct = distinct[:, None]
            else:
                keys = part.view(np.dtype((np.void, part.itemsize * width)))[:, 0]
                _, first, codes = np.unique(keys, return_index=True, return_inverse=True)
                distinct = part[first]
            if width == 1 or len(distinct) * SHARE <= len(part):
                out.append((at, width, distinct, codes.reshape(-1)))
                at += width
                break
    return out


def write_pages(kept: DataFrame, page: int = PAGE) -> DataFrame:
    """kept_vectors() as pages: vec_ids, and of all blocks end to end first components, widths, dictionary sizes, subvectors and codes."""
    kinds = pa.schema([("vec_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("subvectors", pa.binary()), ("codes", pa.binary())])

    def encode(batches):
        ids, vectors, held = [], [], 0

        def flush():
            blocks = dictionary_blocks(integers(np.concatenate(vectors)))
            row = [pa.concat_arrays(ids), [b[0] for b in blocks], [b[1] for b in blocks], [len(b[2]) for b in blocks], b"".join(b[2].astype("<i4").tobytes() for b in blocks), b"".join(b[3].astype("<u2").tobytes() for b in blocks)]
            ids.clear(), vectors.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], f.type) for x, f in zip(row, kinds)], schema=kinds)

        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            at = 0
            while at < batch.num_rows:
                n = min(page - held, batch.num_rows - at)
                ids.append(batch.column(0).slice(at, n))
                vectors.append(flat[at : at + n])
                held, at = held + n, at + n
                if held == page:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return materialize(kept.select("vec_id", "embedding").mapInArrow(encode, "vec_ids array<long>, firsts array<int>, widths array<int>, counts array<int>, subvectors binary, codes binary"), "pages")


def _blocks(row: dict, n: int):
    """(first component, width, subvectors, codes) of a page's blocks."""
    subs, codes, at = np.frombuffer(row["subvectors"], "<i4"), np.frombuffer(row["codes"], "<u2").reshape(-1, n), 0
    for i, (first, width, count) in enumerate(zip(row["firsts"], row["widths"], row["counts"])):
        yield first, width, subs[at : at + count * width].reshape(count, width).astype(np.int64), codes[i]
        at += count * width


def _nearest(row: dict, centroids: np.ndarray):
    """Cluster and distance of a page's vectors: partial distances of the dictionaries' subvectors, summed by code."""
    n = len(row["vec_ids"])
    total = np.zeros((n, len(centroids)), np.int64)
    for first, width, subs, codes in _blocks(row, n):
        apart = subs[:, None, :] - centroids[None, :, first : first + width]
        total += (apart * apart).sum(2)[codes]
    cluster = total.argmin(1)  # the first of equals
    return cluster, total[np.arange(n), cluster]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def round_sums(pages: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, component, sum, n): exact sums and counts of the vectors nearest to each centroid; n is the same for all components."""

    def step(batches):
        k, size = centroids.shape
        sums, members = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for row in _rows(batches):
            cluster, _ = _nearest(row, centroids)
            members += np.bincount(cluster, minlength=k)
            for first, width, subs, codes in _blocks(row, len(cluster)):
                times = np.bincount(cluster * len(subs) + codes, minlength=k * len(subs)).reshape(k, len(subs))
                sums[:, first : first + width] += times @ subs
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(members), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    each = pages.mapInArrow(step, "cluster int, n long, sums array<long>").where("n > 0").select("cluster", "n", F.posexplode("sums").alias("component", "x"))
    return each.groupBy("cluster", "component").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))


def cluster_vectors(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) of (vec_id, embedding) rows.

    To the driver come `centroids` vectors and their sums a round, nothing that grows with the rows.  Fewer vectors than centroids give fewer
    centroids; a centroid without vectors stays where it is; of equally near ones the first counts."""
    kept = kept_vectors(rows)
    now = first_centroids(kept, centroids, seed)
    if not len(now):
        # vectors without an id alone have no first centroid: nothing can be assigned
        return kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    pages = write_pages(kept)
    for _ in range(rounds):
        new = now.copy()
        for r in round_sums(pages, now).collect():
            new[r["cluster"], r["component"]] = int(r["sum"]) // r["n"]
        now = new

    def assign(batches):
        for row in _rows(batches):
            cluster, distance = _nearest(row, now)
            yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = materialize(pages.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(pages)
    return found, now


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings that have 64 finite components: one row for each such row.

    Rows with a null vector, another length, or a null, infinite or undefined component are left out; repeated rows are clustered one by one; a null id stays null and is
    never a first centroid; ties go to the smaller cluster; other columns don't matter; an empty table gives an empty table.  A component of 131,072 or more in
    size is an error, as its distances exceed a long."""
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    each = F.array(*[F.lit(sums.get(k, 0)).cast("long") for k in range(max(1, len(centroids)))])
    digests = F.array(*([F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in centroids] or [F.lit("")]))
    return found.select("vec_id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"))


def _sql() -> str:
    """The rounds one after another, every vector against every centroid."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q FROM v WHERE vec_id IS NOT NULL QUALIFY k < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, v.vec_id, v.q, k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT k, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, range(1, {SIZE + 1}) t(j) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, q) AS q FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c USING (k)"""


OP11_SQL = _sql()
