"""Secrets in texts: fixed forms, and strings whose characters are too evenly spread.

Forms are found by patterns; the places between matches give their offsets.  Candidate strings go through a sliding
window of WINDOW characters: each step takes one character out of the counts and one in, and keeps the sum of
c log2 c from which the entropy follows (in millionths, as integers, so that every engine agrees).
Windows above their class's limit mark the stretch they cover, unless an allow-list pattern knows it as harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import let, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = r"(AKIA[A-Z0-9]{16,})", r"([0-9a-f]{24,})"
ASSIGN_LEAST = 6
#: Texts of more characters are scanned in blocks of so many pieces.
LONG, PIECES = 65_536, 1024
#: After these places a long text may be cut: a character that no form and no candidate holds, or a single space that isn't beside a colon or an equals sign, which alone may
#: have spaces around them inside a form.
CUT = r"""(?<=[^A-Za-z0-9+/_.=\-"':\x20])|(?<=[^:=\x20]\x20)(?![:=\x20])"""

CANDIDATE, WINDOW = r"([A-Za-z0-9+/_=-]{20,})", 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Entropy limits in bits, by class of character.
LIMITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Harmless: UUIDs, words joined by marks, alphabets in order, documented examples.
ALLOW = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[+/_=-]*[A-Za-z]+([+/_=-]+[A-Za-z]+)*[+/_=-]*[0-9]{0,4}$|abcdefgh|ABCDEFGH|01234567|EXAMPLE|example"
#: The forms that a whole candidate must have, and the words that excuse only the part between marks in which they stand.
ALLOW_FORM, ALLOW_WORD = ALLOW.split("|abcdefgh")[0], "abcdefgh" + ALLOW.split("|abcdefgh")[1]

_MILLION = 1_000_000
C_LOG_C = [round(_MILLION * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def limit_of(kind: str) -> int:
    """The largest sum of c log2 c that a window at the class's limit may have."""
    return math.floor(_MILLION * WINDOW * (math.log2(WINDOW) - LIMITS[kind]))


def _places(text: Column, pattern: str, least: int | None = None) -> Column:
    """Array of (start, end) of the matches of a pattern's group 1; least: shortest group 2."""
    kind = "array<struct<start:int,end:int,ok:boolean>>"

    def found(gaps: Column, hits: Column, values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(hits, i))
            ok = F.lit(True) if least is None else F.length(F.get(values, i)) >= least
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), ok.alias("ok")))).alias("out"))

        every = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.aggregate(every, zero, step, lambda a: a["out"]), lambda x: x["ok"])

    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("hits"),
                     F.regexp_extract_all(text, F.lit(pattern), 2 if least else 1).alias("values"))
    return F.when(text.rlike(pattern), let(parts, lambda p: found(p["gaps"], p["hits"], p["values"]))).otherwise(F.array().cast(kind))


def _hot(candidate: Column) -> Column:
    """Runs (start, end) of a candidate that windows above the limit cover, by incremental counts; windows that overlap or touch make one run; null if it isn't scanned."""
    table_ = F.array(*[F.lit(x).cast("long") for x in C_LOG_C])
    limit = (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), limit_of("hex")).when(candidate.rlike("^[A-Za-z0-9]+$"), limit_of("alnum")).otherwise(limit_of("base64"))
    )
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    add = lambda counts, code, by: F.transform(counts, lambda c, i: F.when(i == code, c + by).otherwise(c))
    run = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))

    def scan(x: Column) -> Column:
        none = F.lit(None).cast("int")
        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("runs"))

        def step(a: Column, i: Column) -> Column:
            gone, new = F.get(x["codes"], i - WINDOW), F.get(x["codes"], i)
            without = F.when(i < WINDOW, F.struct(a["counts"].alias("counts"), a["sum"].alias("sum"))).otherwise(
                F.struct(add(a["counts"], gone, -1).alias("counts"), (a["sum"] - F.get(table_, F.get(a["counts"], gone)) + F.get(table_, F.get(a["counts"], gone) - 1)).alias("sum")))

            def enter(b: Column) -> Column:
                total = b["sum"] - F.get(table_, F.get(b["counts"], new)) + F.get(table_, F.get(b["counts"], new) + 1)
                hot = (i >= WINDOW - 1) & (total <= x["limit"])
                start = i - WINDOW + 1
                fresh = hot & (a["last"].isNull() | (start > a["last"]))
                return F.struct(add(b["counts"], new, 1).alias("counts"), total.alias("sum"), F.when(fresh, start).otherwise(a["first"]).alias("first"), F.when(hot, i + 1).otherwise(a["last"]).alias("last"),
                                F.when(fresh & a["last"].isNotNull(), F.concat(a["runs"], run(a["first"], a["last"]))).otherwise(a["runs"]).alias("runs"))

            return let(without, enter)

        return F.aggregate(F.sequence(F.lit(0), F.size(x["codes"]) - 1), zero, step, lambda a: F.when(a["last"].isNotNull(), F.concat(a["runs"], run(a["first"], a["last"]))).otherwise(a["runs"]))

    worth = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~candidate.rlike(ALLOW_FORM)
    return F.when(worth, let(F.struct(codes.alias("codes"), limit.alias("limit")), scan))


#: A part between marks that holds a harmless word.
ALLOWED_PART = rf"([A-Za-z0-9]*(?:{ALLOW_WORD})[A-Za-z0-9]*)"


def _outside(c: Column, cuts: Column) -> Column:
    """The stretches (start, end) of c of WINDOW characters or more outside `cuts`, which are in order of start."""
    inside = F.filter(cuts, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(c["start"].alias("at"), F.array().cast(kind).alias("out"))
    stretch = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] - a["at"] >= WINDOW, F.concat(a["out"], stretch(a["at"], s["start"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(inside, zero, step, lambda a: F.when(c["end"] - a["at"] >= WINDOW, F.concat(a["out"], stretch(a["at"], c["end"]))).otherwise(a["out"]))


def blocks_of(text: Column) -> Column:
    """Array of a text's blocks of PIECES pieces, the whole text if it isn't long: end to end they are the text again.

    No form and no candidate reaches over a cut, in one line or many, so blocks are scanned each by itself and the work grows with a text's length alone.  Only a stretch
    without any cut stays whole."""
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(PIECES)), lambda i: F.array_join(F.slice(x, i + 1, F.lit(PIECES)), ""))
    return F.when(F.length(text) > LONG, let(F.split(text, CUT), pieces)).otherwise(F.array(text))


def spans(text: Column) -> Column:
    """All spans of a text, by start and then kind: array of (start, kind, end), kind an index of KINDS.

    Offsets count code points, ends are exclusive; a null text counts as empty.  Of a candidate, the stretches of WINDOW characters or more outside other spans
    and outside parts between marks that hold a harmless word are scanned, each by itself."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, b: F.struct((a["at"] + F.length(b)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    moved = lambda b, base: F.transform(_spans_in(b), lambda s: F.struct((s["start"] + base).alias("start"), s["kind"].alias("kind"), (s["end"] + base).alias("end")))
    return let(blocks_of(F.coalesce(text.cast("string"), F.lit(""))), lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, zero, step, lambda a: a["out"]), moved)))


def _spans_in(text: Column) -> Column:
    """spans() of one block."""
    tag = lambda places, kind: F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    base = F.concat(tag(_places(text, ASSIGN, ASSIGN_LEAST), "assign"), tag(_places(text, ACCESS), "access"), tag(_places(text, HEX), "hex"))

    def with_entropy(b: Column) -> Column:
        # only candidates of a form that isn't allowed are cut
        whole = F.filter(_places(text, CANDIDATE), lambda c: ~F.substring(text, c["start"] + 1, c["end"] - c["start"]).rlike(ALLOW_FORM))
        known = F.transform(b, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        words = F.transform(_places(text, ALLOWED_PART), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        free = F.when(F.size(whole) > 0, let(F.array_sort(F.concat(known, words)), lambda cuts: F.flatten(F.transform(whole, lambda c: _outside(c, cuts))))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        hot = lambda c: F.transform(F.coalesce(_hot(F.substring(text, c["start"] + 1, c["end"] - c["start"])), F.array().cast("array<struct<start:int,end:int>>")), lambda h: F.struct((c["start"] + h["start"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + h["end"]).alias("end")))
        return F.array_sort(F.concat(b, F.flatten(F.transform(free, hot))))

    return let(base, with_entropy)


def scan(docs: DataFrame) -> DataFrame:
    """Adds to (doc_id, text) rows: doc_id, spans (as spans()).  One row for each row; an empty table gives an empty table."""
    return docs.select("doc_id", spans(F.col("text")).alias("spans"))


def redact(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of touching spans replaced by a mark; null stays null."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def block(b: Column, found: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            fresh = s["start"] >= a["at"]
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.substring(b, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(found, zero, step, lambda a: F.concat(a["out"], F.substring(b, a["at"] + 1, F.length(b))))).otherwise(b)

    clean = F.array_join(F.transform(blocks_of(text.cast("string")), lambda b: let(_spans_in(b), lambda found: block(b, found))), "")
    return F.when(text.isNotNull(), clean)


def redacted(docs: DataFrame) -> DataFrame:
    """Rows of `docs` with the text redacted, and n_chars, if there, counted anew where the text has changed.

    One row for each row, other columns as they are, whatever they are called; a null text stays null, an empty table stays empty.  Equal texts are redacted alike."""
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), redact(F.col("text")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return made.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def spell(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: one row for each row, so repeated rows give repeated rows.

    A null or empty text has no spans and the digest of an empty string; a text of any length is scanned whole; a null doc_id stays null; other columns don't
    matter; of spans that start together the kinds' order decides.  An empty table gives an empty table."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"), count("entropy").alias("n_entropy"))


def secrets_sql(source: str = "documents") -> str:
    """CTEs ending in s_all(doc_id, start, kind, end_) over a relation with doc_id, text."""
    quote = lambda x: x.replace("'", "''")
    assign_free = ASSIGN.replace("([A-Za-z0-9+/_.=-]+))", "[A-Za-z0-9+/_.=-]+)")

    def places(name: str, kind: int, pattern: str, split: str, keep: str) -> str:
        return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{quote(split)}') AS m, regexp_split_to_array(text, '{quote(split[1:-1])}') AS g{", regexp_extract_all(text, '" + quote(pattern) + "', 2) AS v" if kind == 0 else ", NULL::VARCHAR[] AS v"}
    FROM s_docs WHERE regexp_matches(text, '{quote(split)}')),
{name}_i AS (SELECT doc_id, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, {kind} AS kind, m[i] AS s,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM {name}_i WHERE {keep})"""

    table_ = "[" + ", ".join(map(str, C_LOG_C[1:])) + "]"
    return f"""
s_docs AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),{places("s_assign", 0, ASSIGN, assign_free, f"length(v[i]) >= {ASSIGN_LEAST}")},{places("s_access", 1, ACCESS, ACCESS, "true")},{places("s_hex", 2, HEX, HEX, "true")},
s_base AS (SELECT doc_id, kind, start, start + length(s) AS end_ FROM (FROM s_assign UNION ALL FROM s_access UNION ALL FROM s_hex)),{places("s_cand", 3, CANDIDATE, CANDIDATE, "true")},{places("s_word", 3, ALLOWED_PART, ALLOWED_PART, "true")},
s_open AS (SELECT doc_id, start, start + length(s) AS end_ FROM s_cand WHERE NOT regexp_matches(s, '{quote(ALLOW_FORM)}')),
s_cuts AS (SELECT doc_id, start, end_ FROM s_base UNION ALL SELECT doc_id, start, start + length(s) FROM s_word),
s_edges AS (SELECT c.doc_id, c.start AS begin_, k.start, k.end_ FROM s_open c JOIN s_cuts k ON k.doc_id = c.doc_id AND k.start < c.end_ AND c.start < k.end_
    UNION ALL SELECT doc_id, start, end_, end_ FROM s_open),
s_gaps AS (SELECT doc_id, start AS stop_, greatest(begin_, coalesce(max(end_) OVER (PARTITION BY doc_id, begin_ ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start FROM s_edges),
s_free AS (SELECT * FROM (SELECT doc_id, g.start, substring(text, g.start::BIGINT + 1, (stop_ - g.start)::BIGINT) AS s FROM (SELECT DISTINCT * FROM s_gaps WHERE stop_ - start >= {WINDOW}) g JOIN s_docs USING (doc_id))
    WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '{quote(ALLOW_FORM)}')),
s_windows AS (SELECT doc_id, start, w, CASE WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN {limit_of("hex")} WHEN regexp_matches(s, '^[A-Za-z0-9]+$') THEN {limit_of("alnum")} ELSE {limit_of("base64")} END AS most,
    string_split(substring(s, w + 1, {WINDOW}), '') AS c FROM (SELECT *, unnest(range(0, length(s) - {WINDOW - 1})) AS w FROM s_free)),
s_hot AS (SELECT doc_id, start, w FROM s_windows
    WHERE list_sum(list_transform(list_distinct(c), lambda x: {table_}[len(list_filter(c, lambda y: y = x))])) <= most),
s_runs AS (SELECT doc_id, start, w, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY w) AS run
    FROM (SELECT *, (w - coalesce(lag(w) OVER (PARTITION BY doc_id, start ORDER BY w), -1000) > {WINDOW})::INT AS fresh FROM s_hot)),
s_all AS (FROM s_base UNION ALL SELECT doc_id, 3 AS kind, start + min(w) AS start, start + max(w) + {WINDOW} AS end_ FROM s_runs GROUP BY doc_id, start, run)"""


_NAMES = "['" + "', '".join(KINDS) + "']"
OP6_SQL = f"""WITH {secrets_sql()},
s_texts AS (SELECT doc_id, kind, start, {_NAMES}[kind + 1] || ':' || start::BIGINT || ':' || end_::BIGINT AS t FROM s_all)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
    coalesce(string_agg(t, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_entropy
FROM s_docs d LEFT JOIN s_texts USING (doc_id) GROUP BY d.doc_id"""
