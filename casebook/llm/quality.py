"""Quality rules of documents, and verdicts on the hosts they come from.

Each text is counted in one pass of built-in functions.  Rules turn the counts into failures; failures are
summed by host and each host's rate is shrunk towards all hosts' by a beta prior fitted to their rates (method
of moments).  The host's verdict goes back to its documents: one soft failure, harmless on a good host, rejects a
document of a bad one.  A document that fails no rule is kept on any host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import WORD, let, materialize, table

#: Rules: fewest words; per cent of words in repeated windows, of symbols to words, of repeated lines; characters a word.
FEWEST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTH = 50, 50, 10, 30, (2, 15)
#: A host is bad if its shrunk failure rate is above this; so many soft failures reject on any host.
BAD_HOST, SOFT_LIMIT = 0.5, 2
#: Host tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_HOSTS = 100_000
#: Words up to which positions are packed under window hashes, to find the few places that can be repeats.
PACKED = 1 << 20
#: Weight of the prior in documents, least and most.
PRIOR = (1.0, 1_000_000.0)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the array holds more than once.

    Windows are hashed; for the few arrays in which hashes repeat, positions are packed under the hashes and sorted, so that equal windows
    are neighbours.  The position takes as many bits of the hash as the array's size has, so what the rest finds is compared anew by whole hashes; arrays far longer than
    PACKED go to that comparison at once."""
    call = F.call_function

    def covered(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes).cast("long")))
        high = lambda x: call("shiftright", x, bits)
        packed = F.sort_array(F.transform(hashes, lambda h, i: call("shiftleft", high(h), bits).bitwiseOR(i.cast("long"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda v, i: (high(v) == high(F.get(s, i - 1))) | (high(v) == high(F.get(s, i + 1))))
            spots = F.transform(same, lambda v: (v - call("shiftleft", high(v), bits)).cast("int"))
            return let(F.array_sort(F.transform(spots, lambda p: F.struct(F.get(hashes, p).alias("h"), p.cast("long").alias("i")))), beside)

        def beside(s: Column) -> Column:
            same = F.filter(s, lambda v, i: (v["h"] == F.get(s, i - 1)["h"]) | (v["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(same, lambda v: v["i"]))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        found = F.when(F.size(hashes) <= PACKED, let(packed, places)).otherwise(let(pairs, beside))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(found, zero, step, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    found = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(t)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(found)


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.  A null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    length = lambda x: F.length(x).cast("long")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return let(F.struct(counted.alias("w"), dup.alias("l")), lambda c: F.struct(
        c["w"]["n"].alias("n_words"), length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        (length(text) - length(F.regexp_replace(text, "[#*$%&|<>]", ""))).alias("n_symbols"),
        c["l"]["n"].alias("n_lines"), c["l"]["d"].alias("n_dup_lines"), c["w"]["r"].alias("n_repeat_words")))


def failures(c: Column) -> tuple[Column, Column]:
    """From text_counts: whether a base rule fails, and how many soft rules do."""
    base = (c["n_words"] < FEWEST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    soft = [
        100 * c["n_symbols"] > MOST_SYMBOLS * c["n_words"],
        100 * c["n_dup_lines"] > MOST_DUP_LINES * c["n_lines"],
        (c["word_chars"] < WORD_LENGTH[0] * c["n_words"]) | (c["word_chars"] > WORD_LENGTH[1] * c["n_words"]),
    ]
    return base, sum((x.cast("int") for x in soft), F.lit(0))


def host_rates(counted: DataFrame) -> tuple[DataFrame, int]:
    """(host, failed) rows to host, n, failures, rate (shrunk); and the number of hosts."""
    hosts = materialize(counted.groupBy("host").agg(F.count("*").alias("n"), F.sum("failed").alias("failures")), "hosts")
    raw = F.col("failures") / F.col("n")
    row = hosts.agg(F.count("*").alias("k"), F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).first()
    m, v = row["m"] or 0.0, row["v"] or 0.0
    weight = min(max(m * (1 - m) / v - 1, PRIOR[0]), PRIOR[1]) if v > 0 else PRIOR[1]
    rate = (F.col("failures") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate), row["k"]


def _kept(base: Column, soft: Column, rate: Column) -> Column:
    return ~base & (soft < SOFT_LIMIT) & ~((soft > 0) & (rate > BAD_HOST))


def _with_rates(rows: DataFrame, rates: DataFrame, hosts: int) -> DataFrame:
    rates = rates.select("host", "rate")
    return rows.join(F.broadcast(rates) if hosts <= BROADCAST_HOSTS else rates, "host", "left")


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept, one row for each row of `docs`.

    A null host counts as the empty one; an empty table gives an empty table; repeated rows are judged alike."""
    base, soft = failures(F.col("c"))
    counted = docs.select(F.col("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_counts(F.col("text")).alias("c"))
    counted = materialize(counted.select("doc_id", "host", "c.*", base.alias("base_failed"), soft.alias("soft")), "counts")
    rates, k = host_rates(counted.select("host", (F.col("base_failed") | (F.col("soft") > 0)).cast("int").alias("failed")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return _with_rates(counted, rates, k).select(
        "doc_id", *names, _kept(F.col("base_failed"), F.col("soft"), F.col("rate")).alias("kept"), F.col("rate").alias("host_rate")
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows of `docs` that verdicts() keeps, with their own columns, whatever else those are called.

    Rows that may be kept are written once beside their host and failures, so that no text is counted twice.  A null or empty text has no words and goes; a null host
    counts as the empty one; repeated rows stay or go together; an empty table stays empty."""
    base, soft = failures(F.col("counts"))
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), text_counts(F.col("text")).alias("counts"))
    judged = counted.select("row", "host", base.alias("base"), soft.alias("soft"))
    written = materialize(judged.select(F.when(~F.col("base") & (F.col("soft") < SOFT_LIMIT), F.col("row")).alias("row"), "host", "base", "soft"), "judged")
    rates, k = host_rates(written.select("host", (F.col("base") | (F.col("soft") > 0)).cast("int").alias("failed")))
    kept = _with_rates(written.where("row IS NOT NULL"), rates, k).where(_kept(F.col("base"), F.col("soft"), F.col("rate")))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents: one row for each row, so repeated rows give repeated rows.

    A null or empty text has no words and fails; a text of any length is counted whole; a null source counts as the empty one; other columns don't matter.
    An empty table gives an empty table."""
    found = verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_sql(source: str = "documents") -> str:
    """CTEs ending in quality(doc_id, ..., kept) over a relation with doc_id, text, source."""
    low, high = WORD_LENGTH
    return rf"""
q_words AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {source}),
q_windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM q_words WHERE len(w) >= 4),
q_repeats AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) AS n FROM q_windows),
q_places AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_repeats WHERE n > 1) GROUP BY doc_id),
q_lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM q_words),
q_counts AS (SELECT q_words.doc_id, host, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM q_words JOIN q_lines USING (doc_id) LEFT JOIN q_places USING (doc_id)),
q_rules AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    (100 * n_symbols > {MOST_SYMBOLS} * n_words)::INT + (100 * n_dup_lines > {MOST_DUP_LINES} * n_lines)::INT
    + (word_chars < {low} * n_words OR word_chars > {high} * n_words)::INT AS soft FROM q_counts),
q_hosts AS (SELECT host, count(*) AS n, sum((base_failed OR soft > 0)::INT) AS f FROM q_rules GROUP BY host),
q_prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM q_hosts),
q_weight AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {PRIOR[0]}), {PRIOR[1]}) ELSE {PRIOR[1]} END AS s FROM q_prior),
quality AS (SELECT q_rules.*, NOT base_failed AND soft < {SOFT_LIMIT} AND NOT (soft > 0 AND (f + m * s) / (n + s) > {BAD_HOST}) AS kept
    FROM q_rules JOIN q_hosts USING (host) CROSS JOIN q_weight)"""


OP5_SQL = f"WITH {quality_sql()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality"
