"""How far a language's sources differ in the terms they use, by chunk factorization.

A block of documents is read as counts of its white-space chunks: its distinct chunks, and for each document their codes and counts.  The distinct
chunks of all blocks meet by hash, where each is cut into terms once, however many documents hold it; a chunk that stands everywhere gives one entry a block and
not one a document.  The terms go back to their blocks, which join them to their documents' codes and sum distinct documents and occurrences by language, source and
term; those sums meet by the term's hash.  Chunks and sums travel as arrays, one row for each block and destination.  Terms never reach over white space, so nothing is
lost at a chunk's ends.

Sources of a language are compared in cells: a cell holds two blocks of sources and a share of the terms, fills in the value that a term without
occurrences has, and returns one partial sum for each pair of its sources.  Terms that no source of a cell has add a constant a pair."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import discard, materialize, release, shuffle_partitions, table
from casebook.llm.vocab import gather, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text a block and a destination; sources a block of a cell, terms a share of one; documents that a kept term is in; ranks of terms that are returned.
BLOCK_BYTES, DEST_BYTES, SOURCES, TERMS, LEAST_DOCS, TOP = 16_000_000, 64_000_000, 64, 8192, 10, 10
#: Sums that a destination holds before it adds up equal ones.
HELD = 4_000_000
SCALE = 1_000_000_000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: A block's counts (kind 0), its distinct chunks for a destination (kind 1), and their terms on the way back (kind 2).
_BLOCK = "block long, kind int, dest int, langs array<string>, sources array<string>, names binary, a binary, b binary, c binary, d binary"
_FIELDS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("dest", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), *[(n, pa.binary()) for n in ("names", "a", "b", "c", "d")]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def pack(values, kind: str = "<i4") -> bytes:
    """Integers as compressed bytes; unpack() is the way back."""
    return zlib.compress(np.asarray(values).astype(kind).tobytes(), 1)


def unpack(raw: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind).astype(np.int64)


def by_dest(names: list[bytes], dests: int):
    """(destination, indexes) of names by their checksums."""
    dest = np.fromiter((zlib.crc32(x) % dests for x in names), np.int64, len(names))
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(dest[order]) != 0)) if len(dest) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        yield int(dest[order[a]]), order[a:b]


def chunk_blocks(docs: DataFrame, dests: int, size: int = BLOCK_BYTES) -> DataFrame:
    """(text, lang, source) rows to blocks of about `size` bytes of text, a longer text alone: kinds 0 (a: group of each document, b: its number of distinct
    chunks, c and d: their codes and counts end to end) and 1 (names: chunks, a: their codes).  Nulls count as empty strings."""

    def count(batches):
        number, base = 0, TaskContext.get().partitionId() << 32
        known, groups, doc_group, sizes, codes, counts, held = {}, {}, [], [], [], [], 0

        def flush():
            nonlocal number, held
            keys, names, block = list(groups), list(known), base + number
            yield _rows([(block, 0, None, [k[0] for k in keys], [k[1] for k in keys], None, pack(doc_group), pack(sizes), pack(np.concatenate(codes)), pack(np.concatenate(counts)))])
            for dest, own in by_dest(names, dests):
                yield _rows([(block, 1, dest, None, None, zlib.compress(b"\n".join([names[i] for i in own.tolist()]), 1), pack(own), None, None, None)])
            number, held = number + 1, 0
            for x in (known, groups, doc_group, sizes, codes, counts):
                x.clear()

        for batch in batches:
            for at, texts in slices(batch.column(0)):
                part = [batch.column(k).slice(at, len(texts)).to_pylist() for k in (1, 2)]
                for text, group in zip(texts.cast(pa.binary()).to_pylist(), zip(*part)):
                    if held and held + len(text) > size:
                        yield from flush()
                    held += len(text) + 1
                    found = Counter(text.split())  # of bytes: cut at ASCII white space alone
                    doc_group.append(groups.setdefault(group, len(groups)))
                    sizes.append(len(found))
                    codes.append(np.array([known.setdefault(k, len(known)) for k in found], np.int32))
                    counts.append(np.fromiter(found.values(), np.int32, len(found)))
        if held:
            yield from flush()
        release()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return own.mapInArrow(count, _BLOCK)


def chunk_terms(blocks: DataFrame, parts: int) -> DataFrame:
    """Kind 2: a block's chunks (a: codes) with their terms (names).  All of a chunk's entries meet in one destination, which cuts it once."""
    term = re.compile(TERM.encode())

    def cut(batches):
        known, now = {}, None
        for batch in batches:
            for block, dest, names, codes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if dest != now:
                    known, now = {}, dest
                out = []
                for chunk in zlib.decompress(names).split(b"\n"):
                    terms = known.get(chunk)
                    if terms is None:
                        terms = known[chunk] = b" ".join(term.findall(chunk.lower()))
                    out.append(terms)
                yield _rows([(block, 2, None, None, None, zlib.compress(b"\n".join(out), 1), codes, None, None, None)])
        release()

    asked = blocks.where("kind = 1").select("block", "dest", "names", "a").repartition(parts, "dest").sortWithinPartitions("dest")
    return asked.mapInArrow(cut, _BLOCK)


def block_sums(blocks: DataFrame, told: DataFrame, dests: int, parts: int) -> DataFrame:
    """Each block's sums for a destination: dest, langs, sources, names (terms), a (group of each), b (documents), c (occurrences)."""

    def resolve(batches):
        row, codes, terms = None, [], []

        def flush():
            groups, sizes, code, times = (unpack(row[x]) for x in "abcd")
            flat = b"\n".join(terms).split(b"\n")
            each = np.fromiter((x.count(b" ") + 1 if x else 0 for x in flat), np.int64, len(flat))
            coded = pa.array(b" ".join([x for x in flat if x]).split(b" "), pa.binary()).dictionary_encode()
            ids, words = np.asarray(coded.indices).astype(np.int64)[: int(each.sum())], coded.dictionary.to_pylist()
            at = np.concatenate(codes)
            has, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            has[at], first[at] = each, np.cumsum(each) - each
            spread_ = has[code]
            key, of = np.unique(np.repeat(np.repeat(np.arange(len(sizes)), sizes), spread_) * len(words) + gather(ids, first[code], spread_), return_inverse=True)
            n = np.bincount(of, np.repeat(times, spread_), len(key)).astype(np.int64)  # below 2^53
            doc, term = np.divmod(key, len(words))
            pair, of = np.unique(term * len(row["langs"]) + groups[doc], return_inverse=True)
            docs, total = np.bincount(of, minlength=len(pair)), np.bincount(of, n, len(pair)).astype(np.int64)
            term, group = np.divmod(pair, len(row["langs"]))
            begin = np.searchsorted(term, np.arange(len(words) + 1))
            for dest, own in by_dest(words, dests):
                own = own[begin[own + 1] > begin[own]]
                k = begin[own + 1] - begin[own]
                spots = gather(np.arange(len(pair)), begin[own], k)
                if len(own):
                    yield _rows([(0, 0, dest, row["langs"], row["sources"], zlib.compress(b" ".join([words[i] for i in own.tolist()]), 1), pack(k), pack(group[spots]), pack(docs[spots], "<i8"), pack(total[spots], "<i8"))])

        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row is not None and r["block"] != row["block"]:
                    if codes:
                        yield from flush()
                    row = None
                if r["kind"] == 0:
                    row, codes, terms = r, [], []
                else:
                    codes.append(unpack(r["a"]))
                    terms.append(zlib.decompress(r["names"]))
        if row is not None and codes:
            yield from flush()
        release()

    met = blocks.where("kind = 0").unionByName(told).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(resolve, _BLOCK)


def kept_counts(sums: DataFrame, least: int, parts: int) -> DataFrame:
    """(lang, source, term, n, all) of the terms in at least `least` documents of a language: occurrences in the source's documents, and in the language's."""
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("all", pa.int64())])

    def add(batches):
        terms, groups, held, size, now = {}, {}, [], 0, None

        def added():
            key, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums_ = []
            for k in (1, 2):
                total = np.zeros(len(key), np.int64)
                np.add.at(total, of, np.concatenate([h[k] for h in held]))
                sums_.append(total)
            return key, *sums_

        def flush():
            key, docs, n = added()
            names, words = list(groups), list(terms)
            langs = {x: i for i, x in enumerate(dict.fromkeys(g[0] for g in names))}
            group, term = key >> 40, key & (1 << 40) - 1
            _, of = np.unique(np.array([langs[g[0]] for g in names])[group] * len(words) + term, return_inverse=True)
            whole, every = np.zeros(of.max() + 1, np.int64), np.zeros(of.max() + 1, np.int64)
            np.add.at(whole, of, docs)
            np.add.at(every, of, n)
            for at in np.array_split(np.flatnonzero(whole[of] >= least), 1 + len(key) // 100_000):
                picked = [[names[g][0] for g in group[at].tolist()], [names[g][1] for g in group[at].tolist()], [words[t].decode() for t in term[at].tolist()], n[at], every[of][at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(picked, out)], schema=out)

        for batch in batches:
            for dest, ls, ss, names, k, group, docs, n in zip(*(batch.column(c).to_pylist() for c in ("dest", "langs", "sources", "names", "a", "b", "c", "d"))):
                if dest != now:
                    if held:
                        yield from flush()
                    terms, groups, held, size, now = {}, {}, [], 0, dest
                own = np.array([terms.setdefault(t, len(terms)) for t in zlib.decompress(names).split(b" ")])
                local = np.array([groups.setdefault(g, len(groups)) for g in zip(ls, ss)])
                held.append((local[unpack(group)] << 40 | np.repeat(own, unpack(k)), unpack(docs, "<i8"), unpack(n, "<i8")))
                size += len(held[-1][0])
                if size >= HELD:
                    held, size = [added()], 0
        if held:
            yield from flush()
        release()

    return sums.repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(add, "lang string, source string, term string, n long, all long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exactly."""
    return (F.lit(1) + F.expr(f"({count} + 2BD) * {SCALE}BD div ({total} + 2BD * {kept})")).cast("long")


def spread(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, exactly."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources: the sum of spread() over its kept terms.

    counts: (lang, source, term, p) of kept terms with occurrences; groups: (lang, source, kept, p0), p0 being the share of a term without any."""
    placed = groups.withColumn("x", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    shards, blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int"), (F.count("*").over(Window.partitionBy("lang")) / SOURCES)
    placed = materialize(placed.withColumns({"shards": shards, "blocks": F.ceil(blocks).cast("int")}), "groups")
    where = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("other", F.expr(f"x div {SOURCES}")), "j": F.greatest("other", F.expr(f"x div {SOURCES}"))})
    own = where(counts.join(placed.select("lang", "source", "x", "shards", "blocks"), ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")))
    # one row a source and share tells the value of a term that the source doesn't have
    marks = where(placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))).withColumn("term", F.lit(None).cast("string")).withColumnRenamed("p0", "p")
    columns = ["lang", "i", "j", "shard", "x", "term", "p"]

    def meet(part: pa.Table) -> pa.Table:
        lang, i, j = (part.column(c)[0].as_py() for c in ("lang", "i", "j"))
        x, p, null = np.asarray(part.column("x")), np.asarray(part.column("p")), np.asarray(part.column("term").is_null())
        sources, order = np.unique(x[null], return_index=True)
        zero = p[null][order]
        coded = part.column("term").combine_chunks().filter(pa.array(~null)).dictionary_encode()
        n = len(coded.dictionary)
        full = np.repeat(zero[:, None], n, axis=1)
        full[np.searchsorted(sources, x[~null]), np.asarray(coded.indices)] = p[~null]
        side = sources // SOURCES
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out = [[], [], []]
        for a in left.tolist():
            b = right[right > a]
            if len(b):
                apart = full[b] - full[a]
                out[0] += [int(sources[a])] * len(b)
                out[1] += sources[b].tolist()
                out[2] += (apart * apart // (full[b] + full[a])).sum(1).tolist()
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "x": pa.array(out[0], pa.int64()), "y": pa.array(out[1], pa.int64()), "value": pa.array(out[2], pa.int64()), "seen": pa.array([n] * len(out[0]), pa.int64())})

    parts = own.select(columns).unionByName(marks.select(columns)).groupBy("lang", "i", "j", "shard").applyInArrow(meet, "lang string, x long, y long, value long, seen long")
    sums = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    end = lambda n, s: placed.select("lang", F.col("x").cast("long").alias(n), F.col("source").alias(s), F.col("p0").alias(f"p_{n}"), *(["kept"] if n == "x" else []))
    named = sums.join(end("x", "one"), ["lang", "x"]).join(end("y", "two"), ["lang", "y"])
    value = F.when(F.col("kept") > 0, F.col("value") + (F.col("kept") - F.col("seen")) * spread("p_x", "p_y")).otherwise(F.lit(0)).cast("long")
    both = named.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("e"))
    return both.select("lang", "e.source", "e.item", "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of (text, lang, source) rows: all pairs of a language's sources, and each source's terms that stand out most.

    Nulls count as empty strings.  A source without terms is compared like any other; a language without kept terms gives pairs of value 0."""
    least_parts = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    dests = max(least_parts, size // DEST_BYTES)
    parts = min(dests, max(least_parts, size // (2 * DEST_BYTES)))
    blocks = materialize(chunk_blocks(docs, dests), "blocks")
    own = materialize(kept_counts(block_sums(blocks, chunk_terms(blocks, parts), dests, parts), least, parts), "own")
    groups = materialize(blocks.where("kind = 0").select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct(), "groups")
    discard(blocks)
    langs = own.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.col("kept") > 0
    sized = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])
    sized = materialize(sized.withColumn("p0", F.when(zero, F.expr(f"1 + {SCALE}BD * 2 div (CASE WHEN kept > 0 THEN total + 2BD * kept END)")).otherwise(1).cast("long")), "sized")
    scored = own.join(sized, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("all", "lang_total", "kept")})
    pairs = source_pairs(scored.select("lang", "source", "term", "p"), sized.select("lang", "source", "kept", "p0"))
    terms = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), spread("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources in each language of `documents`, and each source's ten most telling terms.

    A null text, lang or source counts as empty; repeated rows count each time; a text of any length is read whole; ids and other columns don't matter; equal values rank by
    their items' bytes; a language with one source has no pairs; an empty table gives an empty table."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_LOWER[0]}', '{_LOWER[1]}'), '{TERM}') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(t) AS term FROM d), k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + ({SCALE} * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * l.v))::BIGINT AS p, (1 + ({SCALE} * (k.c + 2)) // (l.n + 2 * l.v))::BIGINT AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
