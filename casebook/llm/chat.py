"""Conversations as training text in windows of a token budget.

Each turn's tokens are added up along its conversation (first inside blocks of turns, then over blocks, so that a very
long conversation isn't summed in one task).  Prefix sums choose turn-aligned windows: the sum is cut into cells of half of what
the budget leaves beside the system turn and the history, and a window takes the turns that start in a cell.  If the last of
them reaches so far beyond the cell that they exceed the budget, it gets a window of its own.  A window repeats the
conversation's opening system turn and the turns that start within HISTORY tokens before it; the loss mask covers assistant texts
that aren't repeated, so each is a target once.

A window holds at most BUDGET tokens, with two exceptions that turn-aligned windows can't avoid: a turn longer than the room for
fresh turns stands alone among them, and a system turn of more than three eighths of the budget is kept whole.  A turn longer than HISTORY
isn't repeated, nor is anything before it.

Template: [SYS]text[/SYS], [INST]text[/INST], <s>text</s> for the assistant, [ROLE:name]text[/ROLE] for any other role.
Inside texts and names, backslash, < and [ are written \\0, \\1 and \\2: no control string can occur there, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import WORD, let, materialize, table

#: Tokens: most of a window; most of its repeated turns, at most an eighth of the budget; what a turn's template counts for.
BUDGET, HISTORY, TURN_TOKENS = 2048, 128, 4
#: Turns a block of the prefix sums.
TURN_BLOCK = 64
#: Stands for a null conv_id inside.
NO_ID = -(1 << 62)

_OPEN = r"(\[SYS\]|\[INST\]|<s>|\[ROLE:[^\]]*\])([^\[<]*)(\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _marks(role: Column) -> tuple[Column, Column]:
    named = F.concat(F.lit("[ROLE:"), F.replace(escape(role), F.lit("]"), F.lit("\\3")), F.lit("]"))
    opening = F.when(role == "system", "[SYS]").when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(named)
    closing = F.when(role == "system", "[/SYS]").when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")
    return opening, closing


def role_of(opening: Column) -> Column:
    inner = unescape(F.replace(F.regexp_extract(opening, r"(?s)^\[ROLE:(.*)\]$", 1), F.lit("\\3"), F.lit("]")))
    return F.when(opening == "[SYS]", "system").when(opening == "[INST]", "user").when(opening == "<s>", "assistant").otherwise(inner)


def word_tokens(text: Column) -> Column:
    """A turn's budgeted size: its words and a few tokens for the template."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)) + TURN_TOKENS


def numbered_turns(turns: DataFrame, tokens=word_tokens) -> DataFrame:
    """(conv_id, turn, role, text) to conv, pos (from 0), role, text, tokens, before (tokens of the turns before).

    Order: turn, then role and text for repeated turn numbers; null turns first; null roles and texts count as empty."""
    own = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": tokens(F.col("text")).cast("long"), "block": F.floor(F.col("turn") / TURN_BLOCK)})
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = own.withColumns({"pos": F.count("*").over(inside) - 1, "before": F.sum("tokens").over(inside) - F.col("tokens")})
    blocks = own.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    along = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = blocks.select("conv", "block", (F.sum("n").over(along) - F.col("n")).alias("pos0"), (F.sum("sum").over(along) - F.col("sum")).alias("before0"))
    return local.join(bases, ["conv", "block"]).select("conv", (F.col("pos") + F.col("pos0")).alias("pos"), "role", "text", "tokens", (F.col("before") + F.col("before0")).alias("before"))


def cell_size(system: Column, budget: int, history: int) -> Column:
    """Half of what a budget leaves beside a system turn and the history, and a quarter of the budget at least."""
    return F.greatest(F.floor((budget - history - system) / 2), F.lit(budget // 4))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens) -> DataFrame:
    """conv_id, window, n_tokens, formatted, n_repeated (leading turns that other windows have as their own), loss (array of start, end in code points).

    Windows ascend along a conversation.  An empty table gives an empty table."""
    if 8 * history > budget:
        raise ValueError("history must not be longer than an eighth of the budget")
    rows = numbered_turns(turns, tokens)
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    celled = rows.join(rows.where(system).select("conv", F.col("tokens").alias("system")), "conv", "left").withColumn("cell_size", cell_size(F.coalesce("system", F.lit(0)), budget, history)).withColumn("cell", F.floor(F.col("before") / F.col("cell_size")))
    reach = celled.groupBy("conv", "cell").agg(F.min("before").alias("begin"), F.max(F.col("before") + F.col("tokens")).alias("end"), F.max("pos").alias("last"))
    # the last turn of a cell alone can exceed it; it starts a window of its own if all are too many
    cut = celled.join(reach, ["conv", "cell"]).withColumn("alone", (F.col("pos") == F.col("last")) & (F.col("end") - F.col("begin") > 2 * F.col("cell_size")) & (F.col("before") > F.col("begin")))
    placed = materialize(cut.select("conv", "pos", "role", "text", "tokens", "before", (F.col("cell") * 2 + F.col("alone").cast("int")).alias("window")), "turns")
    heads = placed.where(system).select("conv", "pos", "role", "text", "tokens")
    starts = placed.groupBy("conv", "window").agg(F.min("before").alias("start"))
    after = Window.partitionBy("conv").orderBy("window")
    # turns within the history of a start lie in one of the two windows before it, since a cell has more than twice the history's tokens
    nexts = starts.select("conv", "window", *[F.lead(c, k).over(after).alias(f"{c}_{k}") for k in (1, 2) for c in ("window", "start")])
    met = placed.join(nexts, ["conv", "window"])
    fields = ("conv", "pos", "role", "text", "tokens")
    own = placed.select(*fields, "window", F.lit(False).alias("again"))
    later = F.filter(F.array(*[F.struct(F.col(f"window_{k}").alias("window"), F.col(f"start_{k}").alias("start")) for k in (1, 2)]), lambda w: w["window"].isNotNull() & (F.col("before") >= w["start"] - history))
    past = met.where(~system).select(*fields, F.explode(later).alias("w")).select(*fields, "w.window", F.lit(True).alias("again"))
    others = starts.where(F.col("start") > 0).select("conv", "window")
    kept = heads.join(others, "conv").select(*fields, "window", F.lit(True).alias("again"))
    opening, closing = _marks(F.col("role"))
    parts = own.union(past).union(kept).select("conv", "window", F.struct("pos", "again", "role", "tokens", opening.alias("a"), escape(F.col("text")).alias("t"), closing.alias("z")).alias("p"))
    grouped = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a window's turns: bounded by its tokens
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["a"])
        end = start + F.length(p["t"])
        target = (p["role"] == "assistant") & ~p["again"]
        return F.struct((end + F.length(p["z"])).alias("at"), F.when(target, F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

    return grouped.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "window", F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("p", lambda p: F.concat(p["a"], p["t"], p["z"])), "").alias("formatted"),
        F.size(F.filter("p", lambda p: p["again"])).alias("n_repeated"), F.aggregate("p", zero, step, lambda a: a["out"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text)."""
    return F.zip_with(F.regexp_extract_all(formatted, F.lit(_OPEN), 1), F.regexp_extract_all(formatted, F.lit(_OPEN), 2), lambda a, t: F.struct(role_of(a).alias("role"), unescape(t).alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation, from formatted windows alone: conv_id, turns (role, text), targets (texts under the loss mask), formatted_chars.

    A conversation's windows meet in one row, since its turns come back as one value: a conversation must fit in a task's memory here, as it need not for
    format_windows().  A null conv_id is one conversation; repeated turns come back as often as given; no windows give no rows."""
    fresh = F.filter(read_turns(F.col("formatted")), lambda t, i: i >= F.col("n_repeated"))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = windows.select("conv_id", F.length("formatted").cast("long").alias("chars"), F.struct("window", fresh.alias("turns"), masked.alias("targets")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("w", lambda w: w["targets"])).alias("targets"), "formatted_chars")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one of id -7, formatted and read back: one row a conversation.

    Null texts and roles count as empty; rows without a conv_id are one conversation; turns are in order of turn (null first), role and text, and repeated rows are
    turns of their own; a long turn is formatted whole; other columns don't matter.  An empty table gives the row of conversation -7."""
    tricky = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    back = read_back(materialize(format_windows(given.unionByName(extra)), "windows"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = rf"""WITH given AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + {TURN_TOKENS} AS tokens,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS chars FROM given),
numbered AS (SELECT *, row_number() OVER w - 1 AS pos, sum(tokens) OVER w - tokens AS before FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
sys AS (SELECT conv_id, tokens AS system FROM numbered WHERE pos = 0 AND role = 'system'),
celled AS (SELECT *, before // size AS cell FROM (SELECT numbered.*, greatest(floor(({BUDGET - HISTORY} - coalesce(system, 0)) / 2), {BUDGET // 4})::BIGINT AS size FROM numbered LEFT JOIN sys USING (conv_id))),
cut AS (SELECT *, cell * 2 + (pos = max(pos) OVER c AND max(before + tokens) OVER c - min(before) OVER c > 2 * size AND before > min(before) OVER c)::INT AS win FROM celled WINDOW c AS (PARTITION BY conv_id, cell)),
starts AS (SELECT conv_id, win, min(before) AS start FROM cut GROUP BY conv_id, win),
again AS (SELECT conv_id, sum(chars) AS chars FROM cut JOIN starts USING (conv_id)
    WHERE before < start AND before >= start - {HISTORY} AND NOT (pos = 0 AND role = 'system') GROUP BY conv_id),
heads AS (SELECT conv_id, sum(chars) AS chars FROM cut JOIN (SELECT conv_id FROM starts WHERE start > 0) USING (conv_id)
    WHERE pos = 0 AND role = 'system' GROUP BY conv_id),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS chars FROM cut GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
    (whole.chars + coalesce(again.chars, 0) + coalesce(heads.chars, 0))::BIGINT AS formatted_chars
FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN heads USING (conv_id)"""
